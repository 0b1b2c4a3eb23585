"""Sets as bitmaps: numbering, containment, and unions over time against plain sets."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeline.functions.names import link_key
from gaugeline.operators import bitmaps as B
from gaugeline.operators import routing as G


def test_numbers_follow_names_inside_a_key(spark):
    rows = [(k, f"{k}{i:04d}") for k in ("link", "node") for i in range(500)]
    got = B.numbered(spark.createDataFrame(rows * 2, "kind string, entity string").repartition(7), ["kind"], "entity")
    for kind in ("link", "node"):
        numbers = [r.number for r in got.where(F.col("kind") == kind).orderBy("entity").collect()]
        assert numbers == list(range(1, 501))


def test_containment_over_several_buckets(spark):
    members = {"a": {1, 40_000, 90_000}, "b": {1, 2}, "c": {70_000}, "d": {5}}
    zones = {"a": [{1, 40_000}, {90_000, 7}], "b": [{1}], "c": [{70_000, 1, 2}]}
    frame = lambda rows: spark.createDataFrame(rows, "key string, number bigint")
    own = B.bitmaps(frame([(k, n) for k, s in members.items() for n in s]), ["key"])
    held = None
    for i in range(2):
        part = B.bitmaps(frame([(k, n) for k, s in zones.items() if i < len(s) for n in s[i]]), ["key"])
        held = part if held is None else held.unionByName(part)
    got = {r.key: (r.n_members, r.n_inside) for r in B.contained(own, held, ["key"]).collect()}
    assert got == {k: (len(s), len(s & set().union(*zones.get(k, [])))) for k, s in members.items()}


@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 200)), min_size=1, max_size=8))
@settings(max_examples=12, deadline=None)
def test_covers_are_exact_and_short(spark, spans):
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i int, a bigint, b bigint")
    for r in frame.select("*", B.dyadic_cover(F.col("a"), F.col("b")).alias("p")).collect():
        ticks = [t for p in r.p for t in range(p.node << p.level, (p.node + 1) << p.level)]
        assert sorted(ticks) == list(range(r.a, r.b)) and len(r.p) <= 16


def test_active_zones_against_plain_sets(spark):
    pick = random.Random(4)
    zones = {f"z{i}": {pick.randrange(1, 60_000) for _ in range(5)} for i in range(6)}
    spans = [(pick.choice("xy"), f"z{pick.randrange(7)}", a, a + pick.randrange(0, 40)) for a in (pick.randrange(300) for _ in range(60))]
    points = [(k, t) for k in "xy" for t in range(0, 340, 3)]
    bits = B.bitmaps(spark.createDataFrame([(k, n) for k, s in zones.items() for n in s], "target string, number bigint"), ["target"])
    found = B.active_zones(
        spark.createDataFrame(points, "run string, tick bigint"), spark.createDataFrame(spans, "run string, target string, s bigint, e bigint"), bits, ["run"], "tick", "s", "e", "target")
    got = {(r.run, r.tick): r.n for r in found.groupBy("run", "tick").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()}
    want = {(k, t): set().union(*(zones.get(z, set()) for r, z, s, e in spans if r == k and s <= t < e)) for k, t in points}
    assert got == {p: len(s) for p, s in want.items() if s}


def test_zones_of_links_against_plain_sets(spark):
    pick = random.Random(2)
    routes = {(f"s{i}", f"h{j}"): [f"s{i}", *(f"s{pick.randrange(20, 30)}" for _ in range(pick.randrange(4))), f"h{j}"] for i in range(8) for j in range(5)}
    rows = [(s, d, k, a, b) for (s, d), path in routes.items() for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if a != b]
    hops = spark.createDataFrame(rows, "src string, dst string, hop int, a string, b string")
    numbers = B.numbered(G.elements(hops).select("kind", "entity"), ["kind"], "entity")
    key = lambda a, b: "-".join(sorted((a, b)))
    want = {}
    for (s, d) in routes:
        own = [(a, b) for x, y, _, a, b in rows if (x, y) == (s, d)]
        for a, b in own:
            links, nodes = want.setdefault(key(a, b), (set(), set()))
            links |= {key(*e) for e in own}
            nodes |= {n for e in own for n in e}
    got = {}
    for r in G.zones(hops, numbers).select("link", "kind", F.bitmap_count("bits").alias("n")).collect():
        got.setdefault(r.link, {})[r.kind] = r.n
    assert got == {k: {"link": len(links), "node": len(nodes)} for k, (links, nodes) in want.items()}
    assert hops.select(link_key(F.col("a"), F.col("b"))).distinct().count() == len(want)
