"""Cases that once gave wrong or lost rows."""

import math
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline import session
from gaugeline.functions import stats
from gaugeline.operators import intervals, routing, scan, whatif
from gaugeline.streaming import feeds


def test_a_route_of_eighty_hops_and_a_loop_of_any_length(spark):
    long = [(f"n{i}", "end", f"n{i + 1}" if i < 79 else "end") for i in range(80)]
    ring = [(f"r{i}", "never", f"r{(i + 1) % 70}") for i in range(70)] + [("tail", "never", "r5"), ("lost", "never", "nowhere")]
    nh = spark.createDataFrame(long + ring, "node string, dst string, next string")
    pairs = spark.createDataFrame([("n0", "end"), ("r3", "never"), ("tail", "never"), ("lost", "never"), ("who", "end"), ("end", "end")], "src string, dst string")
    hops, failed = routing.expand(pairs, nh)
    assert hops.where("src = 'n0'").count() == 80 and hops.where("b = 'end'").count() == 1 and hops.select("src").distinct().count() == 1
    assert {tuple(r) for r in failed.collect()} == {("r3", "never", "loop"), ("tail", "never", "loop"), ("lost", "never", "no route"), ("who", "end", "no route")}
    assert routing.resolve(nh).where("status = 'loop'").count() == 71


def test_a_detour_of_ninety_hops(spark):
    ring = spark.createDataFrame([(f"v{i:02d}", f"v{(i + 1) % 91:02d}") for i in range(91)], "a string, b string")
    found = routing.detours(ring, ring.where("a = 'v00'")).collect()
    assert len(found) == 1 and len(found[0].path) == 91


def test_links_that_are_down_and_flows_without_a_route(spark):
    flows = spark.createDataFrame([("a", "c", 5.0, "udp"), ("b", "c", 30.0, "tcp"), ("a", "x", 1.0, "udp"), ("d", "c", 2.0, "tcp"), ("a", "a", 4.0, "udp")], "src string, dst string, mbps double, kind string")
    hops = spark.createDataFrame([("a", "c", 0, "a", "b"), ("a", "c", 1, "b", "c"), ("b", "c", 0, "b", "c"), ("d", "c", 0, "d", "c")], "src string, dst string, hop int, a string, b string")
    capacity = spark.createDataFrame([("a-b", 10.0), ("b-c", 20.0), ("c-d", 0.0)], "link string, capacity double")
    loads = {(r.a, r.b): (r.rho, r.loss) for r in whatif.link_loads(flows, hops, capacity).collect()}
    assert loads[("d", "c")] == (None, 1.0) and loads[("b", "c")][0] == 1.75
    got = {(r.src, r.dst): r for r in whatif.flow_outcomes(flows, hops, whatif.link_loads(flows, hops, capacity)).collect()}
    assert len(got) == 5
    assert (got[("a", "x")].delivered, got[("a", "x")].reason, got[("a", "x")].reachable) == (0.0, "no route", False)
    assert (got[("d", "c")].delivered, got[("d", "c")].reason, got[("d", "c")].bottleneck) == (0.0, "link down", "d->c")
    assert got[("b", "c")].delivered == pytest.approx(30 / 1.75) and got[("b", "c")].outside_validity and got[("a", "a")].delivered == 4.0


def test_null_keys_are_carried_over_chunks(spark):
    rows = spark.createDataFrame([(None, i) for i in range(6)] + [("k", i) for i in range(6)], "run string, tick bigint")
    got = scan.scan(rows, ["run"], ["tick"], scan.tick_chunk("tick", 2), n=scan.count(), before=scan.previous(F.col("tick")))
    assert sorted((r.run or "", r.tick, r.n, r.before) for r in got.collect()) == sorted((k, i, i + 1, i - 1 if i else None) for k in ("", "k") for i in range(6))
    idx = scan.row_index(rows, ["run"], ["tick"], scan.tick_chunk("tick", 2))
    assert all(r.idx == r.tick for r in idx.collect())


def test_look_back_of_five_thousand_rows(spark):
    rows = spark.range(12_000).selectExpr("'a' as run", "id as i", "id as v")
    spread, keys, own = scan.lookback(rows, ["run"], "i", 5000)
    frame = Window.partitionBy(*keys).orderBy("i").rowsBetween(-5000, -1)
    got = spread.withColumn("s", F.sum("v").over(frame)).where(own)
    assert got.count() == 12_000 and got.where("s <> (least(i, 5000) * (2 * i - least(i, 5000) - 1)) div 2").count() == 0


@pytest.mark.parametrize("k", [0, 2, 500, 501, 5000])
def test_one_poisson_bound_for_every_count(spark, k):
    up = spark.range(1).select(stats.poisson_upper(F.lit(k)).alias("u")).first().u
    total = math.fsum(math.exp(i * math.log(up) - up - math.lgamma(i + 1)) for i in range(k + 1))
    assert total == pytest.approx(0.05, rel=1e-7)


def test_suppression_needs_every_violating_entity_in_the_union_of_radii(spark):
    violating = spark.createDataFrame([("r", 1, "a"), ("r", 1, "b"), ("r", 2, "a"), ("r", 2, "c"), ("r", 3, "a"), ("r", 9, "a"), (None, 1, "a")], "run string, tick bigint, entity string")
    spans = spark.createDataFrame([("r", 0.0, 5.0, ["a", "x"]), ("r", 1.0, 2.0, ["b"]), (None, 0.0, 2.0, ["a"])], "run string, s double, e double, radius array<string>")
    got = {(r.run, r.tick): (r.n_violating, r.n_covered, r.suppressed) for r in intervals.all_covered(violating, spans, ["run"], "tick", "entity", "s", "e", "radius").collect()}
    assert got == {("r", 1): (2, 2, True), ("r", 2): (2, 1, False), ("r", 3): (1, 1, True), ("r", 9): (1, 0, False), (None, 1): (1, 1, True)}


def test_activity_ends_by_kind(spark):
    rows = spark.createDataFrame([("transient", 10.0, 50.0), ("lasting", 10.0, 50.0), ("lasting", 10.0, None)], "kind string, s double, r double")
    ends = rows.select(intervals.active_until(F.col("kind"), F.col("s"), F.col("r"), 8.0, 120.0).alias("e")).collect()
    assert [r.e for r in ends] == [18.0, 58.0, 130.0]


def test_a_stream_goes_on_where_it_stopped_over_a_folder_of_parts(spark, tmp_path):
    source, out, checkpoint = str(tmp_path / "events.parquet"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    schema = spark.range(1).schema
    read = lambda: feeds.file_feed(spark, str(tmp_path / "events.parque[t]"), schema)
    spark.range(0, 100).repartition(3).write.parquet(source)
    feeds.run_available(read(), feeds.append_batches(out), checkpoint=checkpoint)
    spark.range(100, 150).repartition(2).write.mode("append").parquet(source)
    feeds.run_available(read(), feeds.append_batches(out), checkpoint=checkpoint)
    rows = spark.read.parquet(out)
    assert rows.count() == 150 and rows.groupBy("epoch").count().count() == 2


def test_scratch_is_removed_on_request(spark):
    kept = session.cut_lineage(spark.range(5))
    path = session._WRITTEN[spark.sparkContext.applicationId][-1]
    assert kept.count() == 5 and os.path.isdir(path)
    others, session._WRITTEN[spark.sparkContext.applicationId] = session._WRITTEN[spark.sparkContext.applicationId], [path]
    session.drop_scratch(spark)
    session._WRITTEN[spark.sparkContext.applicationId] = others
    assert not os.path.exists(path)
