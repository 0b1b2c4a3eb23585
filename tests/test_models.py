import itertools
import random

from pyspark.sql import functions as F

from gaugeline.operators import chains, forest, resampling, routing
from gaugeline.operators import envelope as O


def test_paths_loops_and_detours(spark):
    table = [("s1", "h2", "s2"), ("s2", "h2", "h2"), ("s3", "h2", "s2"), ("s1", "h9", "s2"), ("s2", "h9", "s1"), ("s3", "h9", "s1")]
    nh = spark.createDataFrame(table, "node string, dst string, next string")
    pairs = spark.createDataFrame([("s1", "h2"), ("s3", "h9"), ("s4", "h2")], "src string, dst string")
    hops, stuck = routing.expand(pairs, nh)
    paths = {(r.src, r.dst): r.via for r in routing.path_arrays(hops).collect()}
    assert paths[("s1", "h2")] == ["s2", "h2"]
    assert sorted((r.src, r.dst) for r in stuck.collect()) == [("s3", "h9"), ("s4", "h2")]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "d"), ("d", "b"), ("x", "y")], "a string, b string")
    found = {(r.a, r.b): r.path for r in routing.detours(edges, spark.createDataFrame([("a", "b"), ("x", "y")], "a string, b string")).collect()}
    assert found == {("a", "b"): ["a", "c", "b"]}


def test_sign_flip_is_exact(spark):
    diffs = [1.0, -0.5, 2.0, 0.25]
    df = spark.createDataFrame(list(enumerate(diffs)), "i long, d double")
    r = resampling.sign_flips(df, "d", "i", "exact").first()
    seen = abs(sum(diffs)) / 4
    hits = sum(abs(sum(s * d for s, d in zip(signs, diffs))) / 4 >= seen - 1e-12 for signs in itertools.product((1, -1), repeat=4))
    assert r.exact and r.n_perm == 16 and abs(r.p_two_sided - hits / 16) < 1e-12


def test_logistic_fails_closed(spark):
    rng = random.Random(2)
    good = [("good", x / 10, rng.random() < 1 / (1 + 2.718281828 ** -(x / 10 - 1))) for x in range(-30, 50)]
    rows = good + [("apart", float(x), x > 5) for x in range(10)] + [("one", float(x), True) for x in range(5)] + [("falls", x / 10, not y) for _, x, y in [(0, a * 10, b) for _, a, b in good]]
    got = {r.k: r for r in resampling.logistic_fits(spark.createDataFrame(rows, "k string, x double, y boolean").withColumn("y", F.col("y").cast("int")), ["k"], "x", "y").collect()}
    assert got["good"].converged and 0.3 < -got["good"].b0 / got["good"].b1 < 1.7
    assert not got["apart"].converged and got["one"].why == "one_class" and got["falls"].why == "slope"


def test_dose_bootstrap_falls_back_to_the_bracket(spark):
    import duckdb

    from gaugeline.plans.registry import QUERIES
    from tools_check import TABLES

    one = lambda rows, **k: resampling.bootstrap_ed50(spark.createDataFrame(rows, "pos long, v double, hit boolean"), "v", "hit", "pos", **k).first()
    apart = one([(0, 4.0, False), (1, 9.0, False), (2, 16.0, True), (3, 50.0, True)], replicates=40)
    assert (apart.method, apart.n_boot, apart.ed50_low, apart.ed50_high) == ("interpolation_fallback", 40, None, None) and abs(apart.ed50 - 12) < 1e-9
    assert set(one([]).asDict().values()) == {None}
    base, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    got = tuple(QUERIES["bootstrap_dose"].run(spark, base).first())
    assert got[0] == 2000 and got == con.execute(QUERIES["bootstrap_dose"].sql).fetchone()


def test_dose_bracket_kinds(spark):
    rows = [("b", 1.0, False), ("b", 100.0, True), ("o", 5.0, True), ("o", 5.0, False), ("o", 9.0, False), ("m", 1.0, False)]
    got = {r.k: r for r in resampling.dose_bracket(spark.createDataFrame(rows, "k string, v double, hit boolean"), ["k"], "v", "hit").collect()}
    assert got["b"].kind == "bracket" and abs(got["b"].ed50 - 10) < 1e-9
    assert got["o"].kind == "overlap" and got["o"].n_inversions == 2 and got["m"].kind == "censored_all_miss"


def test_forest_marks_the_outlier_and_repeats(spark):
    rng = random.Random(4)
    rows = [(f"r{i}", rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)] + [("odd", 9.0, -9.0)]
    df = spark.createDataFrame(rows, "id string, a double, b double")
    nodes = forest.fit(df, "id", ["a", "b"], 301, trees=20, sample=64)
    scored = forest.score(df, nodes, ["a", "b"], 64).orderBy("score").collect()
    assert scored[0].id == "odd" and -1 <= scored[0].score < scored[1].score
    again = forest.fit(df.repartition(7), "id", ["a", "b"], 301, trees=20, sample=64)
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, again.collect()))


def test_chain_finds_the_first_break(spark):
    import hashlib

    lines = ["a", "b", "c", "d"]
    stored = ["genesis"] + [hashlib.sha256(x.encode()).hexdigest() for x in lines[:-1]]
    stored[2] = "0" * 64
    df = spark.createDataFrame([("f", i + 1, lines[i], stored[i]) for i in range(4)], "file string, seq long, line string, prev string")
    r = chains.verify_chain(df, ["file"], "seq", "line", "prev").first()
    assert (r.n_rows, r.n_breaks, r.first_break) == (4, 1, 3)


def test_heldout_bounds_leave_the_fold_out(spark):
    rows = [("p0", "c", 1.0), ("p1", "c", 5.0), ("p2", "c", 9.0)]
    got = {r.fold: (r.lo, r.hi) for r in O.bounds_without(spark.createDataFrame(rows, "fold string, col string, v double"), "fold", "col", "v").collect()}
    assert got == {"p0": (5.0, 9.0), "p1": (1.0, 9.0), "p2": (1.0, 5.0)}
