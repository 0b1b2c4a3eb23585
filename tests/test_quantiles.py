import math
import random

import numpy as np
from pyspark.sql import functions as F

from gaugeline.operators import quantiles as Q
from gaugeline.operators.ranking import top_per_key
from gaugeline.session import cut_lineage


def test_rank_rules_against_sorted_values(spark):
    rng = random.Random(5)
    data = {"hot": [round(rng.expovariate(0.02), 1) for _ in range(997)], "one": [4.0], "ties": [1.0] * 50 + [2.0] * 51, "pair": [1.0, 9.0]}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = Q.quantiles(df, ["k"], "v", {
        "nearest": ("nearest", 0.95), "half_even": ("round", 0.95), "floored": ("floor", 0.95), "linear": ("linear", 0.95),
        "last": ("floor_last", 0.975), "upper": ("upper_median", 0.5), "middle": ("middle", 0.5),
    }, rows=40, count_as="n").collect()
    assert len(got) == 4
    for r in got:
        s = sorted(data[r.k])
        n = len(s)
        assert r.n == n
        assert r.nearest == s[max(0, math.ceil(0.95 * n) - 1)]
        assert r.half_even == s[round(0.95 * (n - 1))]
        assert r.floored == s[min(int(0.95 * n), n - 1)]
        assert abs(r.linear - np.percentile(s, 95)) < 1e-9
        assert r.last == s[int(0.975 * (n - 1))]
        assert r.upper == s[n // 2]
        assert abs(r.middle - np.median(s)) < 1e-12


def test_no_bucket_of_a_million_values_is_large(spark):
    """A key of 10^6 distinct values, most of them crowded together: each bucket is below the row budget."""
    wide = spark.range(1_000_000).select(F.lit("hot").alias("k"), F.when(F.col("id") % 10 == 0, F.col("id") * 1e6).otherwise(1 + F.col("id") * 1e-9).alias("v"))
    placed = cut_lineage(Q.with_buckets(wide.unionByName(wide.limit(50).withColumn("k", F.lit(None).cast("string"))), ["k"], "v", rows=3000))
    per = placed.groupBy("k", "_bucket").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
    assert per.agg(F.max("n")).first()[0] <= 3000 and per.count() > 333
    assert placed.count() == 1_000_050
    spans = [(r.a, r.b) for r in per.where("k = 'hot'").orderBy("_bucket").collect()]
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_auc_does_not_depend_on_the_buckets(spark, monkeypatch):
    df = spark.range(5000).select(F.lit("x").alias("k"), (F.col("id") * 7919 % 1009).cast("double").alias("v"), (F.col("id") % 3 == 0).alias("y"))
    one = Q.ranked_sums(df, ["k"], "v", "y").first()
    monkeypatch.setattr(Q, "ROWS_PER_BUCKET", 50)
    assert Q.ranked_sums(df, ["k"], "v", "y").first() == one


def test_auc_counts_ties_as_half(spark):
    rng = random.Random(1)
    rows = [("x", float(rng.randint(0, 30)), rng.random() < 0.3) for _ in range(400)]
    r = Q.ranked_sums(spark.createDataFrame(rows, "k string, v double, y boolean"), ["k"], "v", "y").first()
    p, q = [v for _, v, y in rows if y], [v for _, v, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q))
    assert abs(r.auc - want) < 1e-12
    assert r.n_at_or_above == sum(a >= b for a in p for b in q)


def test_top_per_key_is_exact(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id", (F.col("id") * 37 % 1001).alias("v"))
    got = {(r.k, r["rank"]): r.id for r in top_per_key(df, ["k"], "v", ["id"], 4).collect()}
    for k in (0, 1):
        want = sorted(((i * 37 % 1001, i) for i in range(5000) if i % 2 == k), key=lambda x: (-x[0], x[1]))[:4]
        assert [got[(k, j + 1)] for j in range(4)] == [i for _, i in want]
