"""What a plan must not hold: work that grows faster than the input, or sides sent through the driver."""

from pyspark.sql import functions as F

from gaugeline.operators import bitmaps as B
from gaugeline.operators import routing as G
from gaugeline.operators import whatif as W
from gaugeline.sources.logs import leaf_queues

HOPS = [("s1", "h9", 0, "s1", "s2"), ("s1", "h9", 1, "s2", "h9"), ("s3", "h9", 0, "s3", "s2"), ("s3", "h9", 1, "s2", "h9")]


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_queue_texts_are_parsed_once(spark):
    text = '[{"kind":"netem","handle":"1:","drops":1,"packets":1},{"kind":"netem","handle":"2:","parent":"1:1","drops":3,"packets":4}]'
    df = spark.createDataFrame([(text,), ("[{",), ("[]",)], "t string").select(leaf_queues(F.col("t")).alias("q"))
    assert [r.q and (r.q.drops, r.q.packets, r.q.signature) for r in df.collect()] == [(3, 4, "netem/2:/1:1"), None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_zones_make_no_bitmap_of_a_route(spark):
    hops = spark.createDataFrame(HOPS, "src string, dst string, hop int, a string, b string")
    numbers = B.numbered(G.elements(hops).select("kind", "entity"), ["kind"], "entity")
    got = G.zones(hops, numbers)
    assert {(r.link, r.kind): (r.n, r.first_entity) for r in got.select("link", "kind", F.bitmap_count("bits").alias("n"), "first_entity").collect()} == {
        ("h9-s2", "link"): (3, "h9-s2"), ("h9-s2", "node"): (4, "h9"), ("s1-s2", "link"): (2, "h9-s2"), ("s1-s2", "node"): (3, "h9"),
        ("s2-s3", "link"): (2, "h9-s2"), ("s2-s3", "node"): (3, "h9")}
    assert "bitmap_or_agg" not in plan(got)


def test_loads_send_no_side_through_the_driver(spark):
    hops = spark.createDataFrame(HOPS, "src string, dst string, hop int, a string, b string")
    flows = spark.createDataFrame([("s1", "h9", 2.0), ("s3", "h9", 5.0)], "src string, dst string, mbps double")
    loads = W.link_loads(flows, hops, spark.createDataFrame([("h9-s2", 10.0)], "link string, capacity double"))
    assert {(r.a, r.b): (r.load, r.n_flows, r.rho) for r in loads.collect()} == {("s1", "s2"): (2.0, 1, None), ("s3", "s2"): (5.0, 1, None), ("s2", "h9"): (7.0, 2, 0.7)}
    assert "Broadcast" not in plan(loads)


def test_zones_deal_the_hops_once(spark):
    hops = spark.createDataFrame(HOPS, "src string, dst string, hop int, a string, b string")
    numbers = B.numbered(G.elements(hops).select("kind", "entity"), ["kind"], "entity")
    assert plan(G.zones(hops, numbers)).count("hashpartitioning(src") == 1
    nodes = G.zones(hops, numbers, keep=lambda e: (e["kind"] == "node") & e["entity"].startswith("s"))
    assert {(r.link, r.kind): (r.n, r.first_entity) for r in nodes.select("link", "kind", F.bitmap_count("bits").alias("n"), "first_entity").collect()} == {
        ("h9-s2", "node"): (3, "s1"), ("s1-s2", "node"): (2, "s1"), ("s2-s3", "node"): (2, "s2")}


def test_a_point_asks_only_levels_that_spans_have(spark):
    points = spark.createDataFrame([("r", 3), ("r", 9), ("r", 40)], "run string, tick bigint")
    spans = spark.createDataFrame([("r", "z", 2, 5)], "run string, target string, s bigint, e bigint")
    zone = B.bitmaps(spark.createDataFrame([("z", 7)], "target string, number bigint"), ["target"])
    got = B.active_zones(points, spans, zone, ["run"], "tick", "s", "e", "target")
    assert [(r.run, r.tick) for r in got.select("run", "tick").collect()] == [("r", 3)]
    asked = spark.range(1).select(B.dyadic_path(F.lit(3), [0, 1]).alias("p")).first().p
    assert [(p.level, p.node) for p in asked] == [(0, 3), (1, 1)]
    assert "[0,1]" in plan(got).replace(" ", "")
