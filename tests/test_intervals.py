import random

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import intervals as I
from gaugeline.operators import matching as M


@pytest.fixture(scope="module")
def data():
    rng = random.Random(9)
    spans = [("k" if i % 3 else "j", i, float(s), float(s + rng.choice([0, 1, 3, 20]))) for i, s in enumerate(rng.choices(range(100), k=60))]
    points = [("k" if i % 2 else "j", i, float(rng.randint(-5, 130))) for i in range(80)]
    return spans, points


@pytest.mark.parametrize("width", [3.0, None])
def test_merge_joins_touching_spans(spark, width):
    df = spark.createDataFrame([("a", 0.0, 5.0), ("a", 5.0, 7.0), ("a", 9.0, 12.0), ("a", 10.0, 11.0), ("b", 1.0, 2.0)], "k string, s double, e double")
    got = sorted((r.k, r.s, r.e) for r in I.merge(df, ["k"], "s", "e", width).collect())
    assert got == [("a", 0.0, 7.0), ("a", 9.0, 12.0), ("b", 1.0, 2.0)]


@pytest.mark.parametrize("width", [7.0, None])
def test_counts_and_owners_against_brute_force(spark, data, width):
    spans, points = data
    s = spark.createDataFrame(spans, "k string, id long, s double, e double")
    p = spark.createDataFrame(points, "k string, pid long, t double")
    counted = {r.pid: r.n_active for r in I.active_counts(p, s.where("e > s"), ["k"], "t", "s", "e", width).collect()}
    owned = {r.pid: (r.owner.id if r.owner else None) for r in I.owners(p, s, ["k"], "t", "s", "e", ["id"], width).collect()}
    for k, pid, t in points:
        live = sorted((a, i) for kk, i, a, b in spans if kk == k and a <= t < b)
        assert counted[pid] == len(live)
        assert owned[pid] == (live[0][1] if live else None)


def test_overlap_and_clip(spark):
    left = spark.createDataFrame([("a", 0.0, 10.0), ("a", 20.0, 30.0)], "k string, s double, e double")
    right = spark.createDataFrame([("a", 5.0, 25.0)], "k string, s double, e double")
    assert I.overlap_seconds(left, right, ["k"], "s", "e", 4.0).first().overlap == 10.0
    assert [(r.s, r.e) for r in I.clip(left, "s", "e", F.lit(8.0), F.lit(20.0)).collect()] == [(8.0, 10.0)]


@pytest.mark.parametrize("forward", [False, True])
def test_as_of_against_brute_force(spark, data, forward):
    spans, points = data
    right = spark.createDataFrame([(k, s, i) for k, i, s, _ in spans], "k string, t double, id long")
    left = spark.createDataFrame(points, "k string, pid long, t double")
    got = {r.pid: (r._hit.at if r._hit else None) for r in M.as_of(left, right, ["k"], "t", ["id"], 11.0, forward).collect()}
    for k, pid, t in points:
        times = [s for kk, _, s, _ in spans if kk == k and (s >= t if forward else s <= t)]
        assert got[pid] == ((min(times) if forward else max(times)) if times else None)


def test_lease_and_completeness(spark):
    df = spark.createDataFrame([(0.0, 5.0), (0.0, None)], "s double, r double")
    assert [x[0] for x in df.select(I.lease_end(F.col("s"), F.col("r"), 8.0, 120.0)).collect()] == [13.0, 120.0]
    a = spark.createDataFrame([(1, "h"), (2, "h"), (3, "l")], "id int, kind string")
    b = spark.createDataFrame([(2, "h"), (9, "h")], "id int, kind string")
    got = {r.kind: (r.expected, r.actual, r.missing, r.extra) for r in M.completeness(a, b, ["id"], ["kind"]).collect()}
    assert got == {"h": (2, 2, 1, 1), "l": (1, 0, 1, 0)}
