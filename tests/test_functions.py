from pyspark.sql import functions as F

from gaugeline.functions import names as N
from gaugeline.functions import stats
from gaugeline.functions.health import host_health, link_health, path_health
from gaugeline.functions.states import level_at, view_label
from gaugeline.operators import envelope as O
from gaugeline.operators import quality as U
from gaugeline.sources import logs as L


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_poisson_table(spark):
    ks = spark.createDataFrame([(0,), (1,), (3,), (2000,)], "k long").select("k", stats.poisson_upper(F.col("k")).alias("u"))
    got = {r.k: r.u for r in ks.collect()}
    assert abs(got[0] - 2.995732) < 1e-6 and abs(got[1] - 4.743865) < 1e-6 and abs(got[3] - 7.753657) < 1e-6
    assert 2073 < got[2000] < 2077


def test_wilson_is_null_without_samples(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(0, 480), (0, 0)], "k long, n long").select(low.alias("a"), high.alias("b")).collect()
    assert rows[0].a == 0.0 and 0.007 < rows[0].b < 0.009 and rows[1].a is None


def test_fisher_known_tables(spark):
    df = spark.createDataFrame([("tea", 3, 1, 1, 3), ("none", 0, 5, 0, 7), ("big", 400000, 600000, 400500, 599500)], "id string, a long, b long, c long, d long")
    got = {r.id: r.p for r in stats.fisher_two_sided(df, ["id"], "a", "b", "c", "d").collect()}
    assert abs(got["tea"] - 0.4857142857) < 1e-9 and got["none"] == 1.0 and 0.4 < got["big"] < 0.55


def test_names(spark):
    r = one(
        spark, N.link_key(F.lit("s2"), F.lit("s1"), "link-").alias("k"), N.entity_of(F.lit("agg.loss_max")).alias("a"), N.entity_of(F.lit("host-h1.traffic.txRate")).alias("e"),
        N.column_kind(F.lit("link-a.traffic.qdiscValid")).alias("b"), N.column_kind(F.lit("host-h1.traffic.txBytes")).alias("c"), N.worst_state(F.lit("ok"), F.lit("critical")).alias("w"),
    )
    assert tuple(r) == ("link-s1-s2", None, "host-h1", "bool", "cumulative", "critical")


def test_health_boundaries_are_strict(spark):
    null = F.lit(None).cast("double")
    r = one(
        spark, link_health(F.lit("up"), F.lit(9.0), null, F.lit(10.0)).alias("a"), link_health(F.lit("up"), F.lit(9.01), null, F.lit(10.0)).alias("b"),
        link_health(F.lit(None).cast("string"), null, null, null).alias("c"), host_health(F.lit("up"), F.lit(14.0), F.lit(2.0)).alias("d"), path_health(null, F.lit(5.1)).alias("e"), path_health(null, null).alias("f"),
    )
    assert tuple(r) == ("warning", "critical", "unknown", "ok", "critical", "unknown")


def test_equality_is_never_a_violation(spark):
    r = one(spark, O.violation(F.lit(5.0), F.lit(1.0), F.lit(5.0)).alias("a"), O.violation(F.lit(None).cast("double"), F.lit(1.0), F.lit(5.0)).alias("b"), O.finite(F.lit("Infinity")).alias("c"), O.finite(F.lit("NaN")).alias("d"))
    assert tuple(r) == (False, False, None, None)


def test_stale_message_has_no_state(spark):
    r = one(spark, view_label(F.lit(False), F.lit("act"), F.lit("")).alias("a"), view_label(F.lit(True), F.lit("unknown"), F.lit("suppressed_intervention")).alias("b"))
    assert tuple(r) == ("stale", "suppressed")


def test_log_lines(spark):
    df = spark.createDataFrame([
        ("[2024-01-01 00:00:01.250000] [ui] [INFO] [cid=c1] CLICK subject=disableLink target=link:l1",), ("[2024-01-01 00:00:02.000000] [x] [INFO] [cid=-] STATE_DETECTED subject=- detail=down",),
        ("[bad] [x] [INFO] [cid=c1] CLICK target=z",), ("[2024-01-01 00:00:03.000000] [x] [INFO] [cid=c1] STATE_OK_AFTER_RESYNC target=link:l1",),
    ], "value string")
    got = [(r.stage, r.cid, r.target, r.expect) for r in L.parse_flow_log(df).collect()]
    assert got == [("click", "c1", "link:l1", "down"), ("ui_resync", "c1", "link:l1", None)]


def test_queue_listing_counts_leaves_only(spark):
    text = '[{"kind":"htb","handle":"5:","drops":9,"packets":90},{"kind":"netem","handle":"10:","parent":"5:1","drops":2,"packets":40}]'
    q = L.leaf_queues(F.lit(text))
    r = one(spark, q["drops"].alias("d"), q["packets"].alias("p"), L.leaf_queues(F.lit("{oops"))["drops"].alias("x"), L.leaf_queues(F.lit('[{"kind":"a","handle":"1:"}]'))["drops"].alias("y"))
    assert tuple(r) == (2, 40, None, None)


def test_schedule_and_gates(spark):
    sched = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("level")), F.struct(F.lit(10).alias("start"), F.lit(7).alias("level")))
    r = one(spark, level_at(sched, F.lit(9)).alias("a"), level_at(sched, F.lit(10)).alias("b"), U.failed({"x": F.lit(True), "y": F.lit(None).cast("boolean"), "z": F.lit(False)}).alias("g"))
    assert tuple(r) == (3, 7, "y,z")
