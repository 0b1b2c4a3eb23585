"""Routing tables as edge tables: paths, influence zones, detours, loops."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.names import link_key
from gaugeline.session import by_sort, cut_lineage

OK, NO_ROUTE, LOOP = "ok", "no route", "loop"


def resolve(next_hop: DataFrame) -> DataFrame:
    """(node, dst, status): whether following ``next_hop(node, dst, next)`` ends at dst, at a node
    without a next hop, or never.

    The table is squared: after round k every row knows where 2^k hops lead, arrival and dead ends
    being final. With as many hops as a destination has nodes, a row that is still under way has met
    a node twice, which proves the loop. Rounds grow with the logarithm of the longest path."""
    table = next_hop.select("node", "dst", F.col("next").alias("at")).where("node <> dst")
    ends = F.when(F.col("at").isNull(), NO_ROUTE).when(F.col("at") == F.col("dst"), OK)
    jump = cut_lineage(table.withColumn("status", ends))
    most = jump.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    hops = 1
    while hops <= most and not jump.where("status is null").isEmpty():
        ahead = jump.select(F.col("node").alias("at"), "dst", F.col("at").alias("_at"), F.coalesce("status", F.lit("")).alias("_status"))
        under_way = jump.where("status is null").join(by_sort(ahead), ["at", "dst"], "left")
        known = F.when(F.col("_status").isNull(), NO_ROUTE).when(F.col("_status") != "", F.col("_status"))
        jump = cut_lineage(jump.where("status is not null").unionByName(under_way.select("node", "dst", F.col("_at").alias("at"), known.alias("status"))))
        hops *= 2
    return jump.select("node", "dst", F.coalesce("status", F.lit(LOOP)).alias("status"))


def expand(pairs: DataFrame, next_hop: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Follow ``next_hop(node, dst, next)`` from every (src, dst), all pairs one hop per round.

    Returns the hops (src, dst, hop, a, b) of all pairs that arrive, and the others with the reason.
    Only pairs that are known to arrive are followed, so the rounds end with the longest path; each
    is written to the shared folder, so a lost executor never replays earlier rounds."""
    table = cut_lineage(next_hop.select("node", "dst", "next"))
    known = pairs.select("src", "dst").distinct().join(by_sort(resolve(table).withColumnRenamed("node", "src")), ["src", "dst"], "left")
    known = cut_lineage(known.select("src", "dst", F.when(F.col("src") == F.col("dst"), OK).otherwise(F.coalesce("status", F.lit(NO_ROUTE))).alias("status")))
    front = known.where((F.col("status") == OK) & (F.col("src") != F.col("dst"))).select("src", "dst", F.col("src").alias("node"))
    rounds = []
    while not rounds or not front.isEmpty():
        moved = cut_lineage(front.join(by_sort(table), ["node", "dst"]).select("src", "dst", F.lit(len(rounds)).alias("hop"), F.col("node").alias("a"), F.col("next").alias("b")))
        rounds.append(moved)
        front = moved.where(F.col("b") != F.col("dst")).select("src", "dst", F.col("b").alias("node"))
    return reduce(DataFrame.unionByName, rounds), known.where(F.col("status") != OK).select("src", "dst", F.col("status").alias("reason"))


def path_arrays(hops: DataFrame) -> DataFrame:
    """One ordered node list per pair; as long as its path."""
    steps = F.array_sort(F.collect_list(F.struct("hop", "b")))
    return hops.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_hops"), F.transform(steps, lambda s: s["b"]).alias("via"))


def elements(hops: DataFrame) -> DataFrame:
    """(src, dst, kind, entity): links and nodes of each route."""
    pair = link_key(F.col("a"), F.col("b"))
    parts = [("link", pair), ("node", F.col("a")), ("node", F.col("b"))]
    return hops.select("src", "dst", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), e.alias("entity")) for k, e in parts])).alias("_x")).select("src", "dst", "_x.*")


def zones(hops: DataFrame, numbers: DataFrame, touched: DataFrame | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(link, kind, bucket, bits, first_entity): all entities on a route that shares the link, per kind, as
    bitmaps of ``numbers`` (kind, entity, number); ``keep`` tells early which (kind, entity) have a number.

    A route is the short list of its hops, dealt once. Its links meet its entities there, repeats go before and
    after the shuffle by link, and what is left gets its numbers. Bits are set once per link; a bitmap of 4 KB
    for a route of a few hops is never made."""
    named = lambda kind, entity: F.struct(F.lit(kind).alias("kind"), entity.alias("entity"))
    hop = F.struct(link_key(F.col("a"), F.col("b")).alias("link"), "a", "b")
    routes = hops.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.collect_set(hop).alias("_hops"))
    own = F.array_distinct(F.flatten(F.transform("_hops", lambda h: F.array(named("link", h["link"]), named("node", h["a"]), named("node", h["b"])))))
    routes = routes.select(F.array_distinct("_hops.link").alias("_links"), (own if keep is None else F.filter(own, keep)).alias("_own"))
    on = routes.select(F.explode("_links").alias("link"), "_own")
    on = on if touched is None else on.join(touched.select("link").distinct(), "link", "left_semi")
    held = on.select("link", F.explode("_own").alias("_x")).select("link", "_x.*").distinct().join(by_sort(numbers), ["kind", "entity"])
    bucket = F.bitmap_bucket_number("number").alias("bucket")
    return held.groupBy("link", "kind", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"), F.min("entity").alias("first_entity"))


def detours(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """Shortest node path between the ends of each cut link without using it, the first by name
    among equals. All cuts search at once: one round grows every frontier by one hop, to nodes not
    seen before, until no frontier is left."""
    both = cut_lineage(edges.select(F.col("a").alias("u"), F.col("b").alias("w")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("w"))).distinct())
    front = cuts.select("a", "b", F.col("a").alias("node"), F.array("a").alias("path"))
    seen = cut_lineage(front.select("a", "b", "node"))
    found = []
    while True:
        grown = front.join(both, front["node"] == both["u"]).where(
            ~(((F.col("u") == F.col("a")) & (F.col("w") == F.col("b"))) | ((F.col("u") == F.col("b")) & (F.col("w") == F.col("a"))))
        )
        step = grown.select("a", "b", F.col("w").alias("node"), F.concat("path", F.array("w")).alias("path"))
        fresh = step.join(seen, ["a", "b", "node"], "left_anti").groupBy("a", "b", "node").agg(F.min("path").alias("path"))
        fresh = cut_lineage(fresh)
        done = fresh.where(F.col("node") == F.col("b"))
        found.append(done.select("a", "b", "path"))
        front = fresh.join(done.select("a", "b"), ["a", "b"], "left_anti")
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front.select("a", "b", "node")))
    return reduce(DataFrame.unionByName, found)
