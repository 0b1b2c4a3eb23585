"""Chunked running values equal plain windows, whatever the chunk width."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline.operators import counters as C
from gaugeline.operators import scan as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for key in ("hot", "b", "c"):
        ticks = sorted(rng.sample(range(200), 120 if key == "hot" else 15))
        data += [(key, t, rng.choice([None, 1.0, 2.0, 5.0, -3.0]), rng.random() < 0.6) for t in ticks]
    return spark.createDataFrame(data, "key string, tick long, v double, flag boolean").repartition(5).cache()


def plain(rows):
    w = Window.partitionBy("key").orderBy("tick")
    upto, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "key", "tick", F.coalesce(F.sum("v").over(upto), F.lit(0.0)).alias("total"), F.max("v").over(past).alias("top"), F.min("v").over(upto).alias("low"),
        F.last("v", True).over(past).alias("known"), F.lag("v").over(w).alias("prev"), F.lead("v").over(w).alias("next"), (F.row_number().over(w) - 1).cast("bigint").alias("n"),
    )


@pytest.mark.parametrize("width,settle", [(1, False), (7, True), (1000, False)])
def test_scan_equals_window(rows, width, settle):
    got = S.scan(
        rows, ["key"], ["tick"], S.tick_chunk("tick", width), settle, total=S.total(F.col("v")), top=S.highest(F.col("v"), before=True), low=S.lowest(F.col("v")),
        known=S.last_known(F.col("v"), before=True), prev=S.previous(F.col("v")), next=S.following(F.col("v")), n=S.count(before=True),
    ).select("key", "tick", "total", "top", "low", "known", "prev", "next", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain(rows).collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("width", [1, 9, 500])
def test_streaks(rows, width):
    got = S.streaks(rows, ["key"], ["tick"], S.tick_chunk("tick", width), {"run": F.col("flag")}, index="i").orderBy("key", "tick").collect()
    key, run, index = None, 0, 0
    for r in got:
        if r.key != key:
            key, run, index = r.key, 0, 0
        run = run + 1 if r.flag else 0
        assert (r.run, r.i) == (run, index)
        index += 1


@pytest.mark.parametrize("width", [3, 64])
def test_lookback_mean(rows, width, monkeypatch):
    monkeypatch.setattr(S.lookback, "__defaults__", (width,))
    got = C.rolling_mean(rows, ["key"], ["tick"], S.tick_chunk("tick", 5), "v", 3, "m").select("key", "tick", "m")
    w = Window.partitionBy("key").orderBy("tick").rowsBetween(-3, -1)
    want = rows.select("key", "tick", F.when(F.count("v").over(w) == 3, F.avg("v").over(w)).alias("m"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(map(tuple, want.collect()), key=lambda r: r[:2])


def test_islands_and_segments(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in [(1, 1), (2, 1), (3, 2), (7, 2), (8, 1), (9, 1)]], "key string, tick long, v int")
    runs = S.islands(df, ["key"], "tick", S.tick_chunk("tick", 2)).groupBy("island").agg(F.min("tick").alias("a"), F.max("tick").alias("b"))
    assert sorted((r.a, r.b) for r in runs.collect()) == [(1, 3), (7, 9)]
    cut = S.segments(df, ["key"], ["tick"], S.tick_chunk("tick", 2), "v")
    assert [r.segment for r in cut.orderBy("tick").collect()] == [1, 1, 2, 2, 3, 3]


def test_even_width_follows_the_crowded_key(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("k"), F.col("id").alias("t"))
    width = S.even_width(df, ["k"], "t", rows_per_chunk=100)
    assert 95 <= width <= 105
    biggest = df.groupBy("k", S.range_chunk("t", width).alias("c")).count().agg(F.max("count")).first()[0]
    assert biggest <= 105


def test_chained_scans_shuffle_their_rows_once(spark, rows):
    """Two scans on one chunk column: one exchange of the rows and one for each carry, NULL keys or not."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        one = S.scan(rows.withColumn("_k", S.tick_chunk("tick", 7)), ["key"], ["tick"], "_k", True, a=S.total(F.col("v")))
        two = S.scan(one, ["key"], ["tick"], "_k", True, b=S.highest(F.col("a")))
        plan = two._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("SortMergeJoin") == 2


def test_null_keys_are_one_key(spark):
    df = spark.createDataFrame([(None, t) for t in range(9)] + [("a", t) for t in range(5)], "key string, tick long")
    got = S.scan(df, ["key"], ["tick"], S.tick_chunk("tick", 2), n=S.count())
    assert sorted((r.key or "", r.tick, r.n) for r in got.collect()) == [("", t, t + 1) for t in range(9)] + [("a", t, t + 1) for t in range(5)]
    other = S.join_null_safe(df, df.withColumnRenamed("tick", "t").groupBy("key").agg(F.max("t").alias("m")), ["key"])
    assert {(r.key, r.m) for r in other.collect()} == {(None, 8), ("a", 4)}
