"""Resampling, dose fits, isolation forest and score calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import counters as C
from gaugeline.operators import forest as X
from gaugeline.operators import metrics as M
from gaugeline.operators import quantiles as Q
from gaugeline.operators import resampling as R
from gaugeline.operators import scan as S
from gaugeline.plans import evaluation as PE
from gaugeline.plans import latency as PL
from gaugeline.plans import quality as PQ
from gaugeline.plans import views as V
from gaugeline.plans.registry import query, r6
from gaugeline.plans.views import SQL_VIEWS
from gaugeline.session import cut_lineage

DRAW = "CAST('0x' || substr(md5('{seed}:' || {parts}), 1, 8) AS BIGINT)"
SUMS = ["tp", "fp", "fn", "tn", "n_unknown_positive", "n_unknown_negative"]


@query("cluster_bootstrap", "ML6", f"""
WITH c AS (SELECT run_id, grp, {PE.CONF} FROM evalframe WHERE in_eval GROUP BY run_id, grp), p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY run_id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM c),
d AS (SELECT b, s.grp, {DRAW.format(seed=7, parts="s.grp || ':' || b || ':' || i")} % s.n AS pos FROM (SELECT grp, n, unnest(range(0, n)) AS i FROM (SELECT DISTINCT grp, n FROM p)) s CROSS JOIN (SELECT unnest(range(0, 2000)) AS b) r),
x AS (SELECT b, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM d JOIN p USING (grp, pos) GROUP BY b), m AS (SELECT tp / nullif(tp + fn, 0) AS recall, fp / nullif(fp + tn, 0) AS fpr FROM x)
SELECT count(recall) AS n_recall, {r6('quantile_cont(recall, 0.025)')} AS recall_low, {r6('quantile_cont(recall, 0.975)')} AS recall_high, count(fpr) AS n_fpr, {r6('quantile_cont(fpr, 0.025)')} AS fpr_low, {r6('quantile_cont(fpr, 0.975)')} AS fpr_high FROM m""")
def cluster_bootstrap(spark, sf):
    f = PE.frame(spark, sf).where("in_eval").withColumn("g", F.substring("run_id", 2, 12).cast("bigint"))
    counts = cut_lineage(f.groupBy("g", "grp").agg(*M.count_columns()))
    clusters = R.numbered(counts, ["grp"], "g")
    reps = M.scores(R.bootstrap_sums(clusters, "grp", "pos", SUMS, 2000, 7))
    # One row per replicate; their number is a parameter.
    return reps.agg(
        F.count("recall").alias("n_recall"), F.percentile("recall", 0.025).alias("recall_low"), F.percentile("recall", 0.975).alias("recall_high"),
        F.count("fpr").alias("n_fpr"), F.percentile("fpr", 0.025).alias("fpr_low"), F.percentile("fpr", 0.975).alias("fpr_high"),
    )


@query("block_bootstrap", "ML7", f"""
WITH p AS (SELECT block, diff, row_number() OVER (ORDER BY block) - 1 AS pos, count(*) OVER () AS n FROM abdiff), d AS (SELECT b, {DRAW.format(seed=11, parts="'all:' || b || ':' || i")} % n AS pos, n FROM (SELECT n, unnest(range(0, n)) AS i FROM (SELECT DISTINCT n FROM p)) CROSS JOIN (SELECT unnest(range(0, 10000)) AS b) r),
m AS (SELECT b, sum(diff) / any_value(d.n) AS v FROM d JOIN p ON p.pos = d.pos GROUP BY b), s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM m)
SELECT {r6('(SELECT avg(diff) FROM p)')} AS mean_diff, {r6('max(CASE WHEN i = floor(0.025 * 9999) THEN v END)')} AS ci_low, {r6('max(CASE WHEN i = floor(0.975 * 9999) THEN v END)')} AS ci_high FROM s""")
def block_bootstrap(spark, sf):
    diffs = cut_lineage(R.block_diffs(PL.ab_trials(spark, sf), "block", "arm", "v"))
    clusters = R.numbered(diffs.withColumn("stratum", F.lit("all")), ["stratum"], "block").withColumn("one", F.lit(1))
    sums = R.bootstrap_sums(clusters, "stratum", "pos", ["diff", "one"], 10000, 11).withColumn("v", F.col("diff") / F.col("one"))
    ci = Q.quantiles(cut_lineage(sums.select("v")), [], "v", {"ci_low": ("floor_last", 0.025), "ci_high": ("floor_last", 0.975)})
    return diffs.agg(F.avg("diff").alias("mean_diff")).join(ci)


SQL_VIEWS["kdiff"] = "SELECT event_type AS block, avg(value) FILTER (WHERE k % 2 = 0) - avg(value) FILTER (WHERE k % 2 = 1) AS diff FROM ev GROUP BY event_type"


@query("sign_flip_exact", "ML8", f"""
WITH p AS (SELECT diff, row_number() OVER (ORDER BY block) - 1 AS i, count(*) OVER () AS n FROM kdiff), s AS (SELECT m, sum(CASE WHEN (m >> i) & 1 = 1 THEN -diff ELSE diff END) AS s, any_value(n) AS n FROM p, (SELECT unnest(range(0, CAST(pow(2, (SELECT count(*) FROM kdiff)) AS BIGINT))) AS m) GROUP BY m)
SELECT {r6('avg(CASE WHEN abs(s) / n >= abs((SELECT sum(diff) FROM p)) / n - 1e-12 THEN 1.0 ELSE 0.0 END)')} AS p_two_sided, true AS exact, count(*) AS n_perm FROM s""")
def sign_flip_exact(spark, sf):
    rows = V.ev(spark, sf).select("event_type", F.when(F.col("k") % 2 == 0, "A").otherwise("B").alias("arm"), "value")
    diffs = cut_lineage(R.block_diffs(rows, "event_type", "arm", "value").withColumn("one", F.lit(0)))
    index = S.row_index(diffs, ["one"], ["event_type"], F.ascii("event_type").cast("bigint"), "i")
    return R.sign_flips(index, "diff", "i", "exact")


@query("sign_flip_sampled", "ML8", f"""
WITH p AS (SELECT diff, row_number() OVER (ORDER BY block) - 1 AS i, count(*) OVER () AS n FROM abdiff),
s AS (SELECT m, sum(CASE WHEN {DRAW.format(seed=20260920, parts="m || ':' || i")} % 2 = 0 THEN diff ELSE -diff END) AS s, any_value(n) AS n FROM p, (SELECT unnest(range(0, 20000)) AS m) GROUP BY m)
SELECT {r6('avg(CASE WHEN abs(s) / n >= abs((SELECT sum(diff) FROM p)) / n - 1e-12 THEN 1.0 ELSE 0.0 END)')} AS p_two_sided, false AS exact, count(*) AS n_perm FROM s""")
def sign_flip_sampled(spark, sf):
    diffs = cut_lineage(R.block_diffs(PL.ab_trials(spark, sf), "block", "arm", "v").withColumn("one", F.lit(0)))
    index = cut_lineage(R.numbered(diffs, ["one"], "block"))
    return R.sign_flips(index, "diff", "pos", "sampled")


SQL_VIEWS["dose"] = "SELECT event_type, log10(greatest(value, 0.001)) AS x, value, value + k * 2 > 150 AS hit FROM ev"


def doses(spark, sf):
    return V.ev(spark, sf).select("event_type", F.log10(F.greatest("value", F.lit(0.001))).alias("x"), "value", (F.col("value") + F.col("k") * 2 > 150).alias("hit"))


@query("dose_bracket", "ML9", """
WITH s AS (SELECT event_type, count(*) FILTER (WHERE hit) AS n_hits, count(*) FILTER (WHERE NOT hit) AS n_misses FROM dose GROUP BY event_type),
m AS (SELECT event_type, value, count(*) AS c FROM dose WHERE NOT hit GROUP BY ALL), i AS (SELECT m.event_type, CAST(sum(m.c * (SELECT count(*) FROM dose h WHERE h.hit AND h.event_type = m.event_type AND h.value <= m.value)) AS BIGINT) AS n FROM m GROUP BY 1)
SELECT s.event_type, n_hits, n_misses, 'overlap' AS kind, CAST(NULL AS DOUBLE) AS ed50, i.n AS n_inversions FROM s JOIN i USING (event_type)""")
def dose_bracket(spark, sf):
    return R.dose_bracket(doses(spark, sf), ["event_type"], "value", "hit")


@query("logistic_fits", "ML10", f"""
WITH RECURSIVE f AS (SELECT event_type, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0 AS i FROM (SELECT DISTINCT event_type FROM dose)
 UNION ALL SELECT event_type, b0 + (c * g0 - b * g1) / (a * c - b * b) AS b0, b1 + (a * g1 - b * g0) / (a * c - b * b) AS b1, i + 1 AS i FROM (
  SELECT f.event_type, f.b0, f.b1, f.i, sum(p * (1 - p)) AS a, sum(p * (1 - p) * x) AS b, sum(p * (1 - p) * x * x) AS c, sum(y - p) AS g0, sum((y - p) * x) AS g1
  FROM f JOIN (SELECT event_type, x, CASE WHEN hit THEN 1.0 ELSE 0.0 END AS y FROM dose) d USING (event_type), LATERAL (SELECT 1 / (1 + exp(-(f.b0 + f.b1 * x))) AS p) WHERE f.i < 25 GROUP BY f.event_type, f.b0, f.b1, f.i))
SELECT event_type, true AS converged, '' AS why, {r6('b0')} AS b0, {r6('b1')} AS b1, {r6('pow(10.0, -b0 / b1)')} AS ed50 FROM f WHERE i = 25""")
def logistic_fits(spark, sf):
    return R.logistic_fits(cut_lineage(doses(spark, sf)), ["event_type"], "x", "hit")


SQL_VIEWS["devdose"] = "SELECT *, log10(m) AS x, row_number() OVER (ORDER BY user_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT user_id, avg(value) AS m, max(value) + max(k) > 330 AS hit FROM ev GROUP BY user_id)"


@query("bootstrap_dose", "ML10", f"""
WITH RECURSIVE w AS (SELECT b, pos, count(*) AS w FROM (SELECT b, {DRAW.format(seed=20260918, parts="b || ':' || pos")} % n AS pos FROM devdose, (SELECT unnest(range(0, 2000)) AS b)) GROUP BY ALL UNION ALL SELECT -1, pos, 1 FROM devdose),
d AS MATERIALIZED (SELECT b, x, CASE WHEN hit THEN 1.0 ELSE 0.0 END AS y, w FROM w JOIN devdose USING (pos)),
f AS (SELECT b, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0 AS i, CASE WHEN min(y) = max(y) THEN 'one_class' ELSE 'live' END AS s, min(x) AS x0, max(x) AS x1 FROM d GROUP BY b
 UNION ALL SELECT b, b0 + d0, b1 + d1, i + 1, CASE WHEN v < 1e-10 THEN 'separation' WHEN d0 IS NULL THEN 'singular' WHEN greatest(abs(b0 + d0), abs(b1 + d1)) > 1e3 THEN 'diverged' WHEN greatest(abs(d0), abs(d1)) >= 1e-10 THEN 'live'
   WHEN b1 + d1 <= 0 THEN 'slope' WHEN -(b0 + d0) / (b1 + d1) BETWEEN x0 - 1 AND x1 + 1 THEN 'ok' ELSE 'extrapolated' END, x0, x1
  FROM (SELECT *, (c * g0 - h * g1) / nullif(a * c - h * h, 0) AS d0, (a * g1 - h * g0) / nullif(a * c - h * h, 0) AS d1 FROM (
   SELECT f.b, f.b0, f.b1, f.i, f.x0, f.x1, min(p * (1 - p)) AS v, sum(w * p * (1 - p)) AS a, sum(w * p * (1 - p) * x) AS h, sum(w * p * (1 - p) * x * x) AS c, sum(w * (y - p)) AS g0, sum(w * (y - p) * x) AS g1
   FROM f JOIN d USING (b), LATERAL (SELECT 1 / (1 + exp(-greatest(least(f.b0 + f.b1 * x, 35.0), -35.0))) AS p) WHERE f.s = 'live' AND f.i < 100 GROUP BY f.b, f.b0, f.b1, f.i, f.x0, f.x1))),
e AS (SELECT b, pow(10.0, -b0 / b1) AS ed50 FROM f WHERE s = 'ok'),
r AS (SELECT count(*) FILTER (WHERE b >= 0) AS n_converged, max(ed50) FILTER (WHERE b < 0) AS fit, quantile_cont(ed50, 0.025) FILTER (WHERE b >= 0) AS low, quantile_cont(ed50, 0.975) FILTER (WHERE b >= 0) AS high FROM e),
k AS (SELECT max(m) FILTER (WHERE NOT hit) AS miss, min(m) FILTER (WHERE hit) AS hit FROM devdose), u AS (SELECT *, fit IS NOT NULL AND n_converged > 1000 AS good FROM r)
SELECT 2000 AS n_boot, n_converged, CASE WHEN good THEN 'logistic' ELSE 'interpolation_fallback' END AS method, {r6("CASE WHEN good THEN fit WHEN miss < k.hit THEN pow(10.0, (log10(miss) + log10(k.hit)) / 2) END")} AS ed50,
  {r6('CASE WHEN good THEN low END')} AS ed50_low, {r6('CASE WHEN good THEN high END')} AS ed50_high FROM u, k""")
def bootstrap_dose(spark, sf):
    """Bootstrap over devices: one dose point per device, drawn by hash, one fit per replicate."""
    per = V.ev(spark, sf).groupBy("user_id").agg(F.avg("value").alias("m"), (F.max("value") + F.max("k") > 330).alias("hit"))
    return R.bootstrap_ed50(R.numbered(per.withColumn("s", F.lit(0)), ["s"], "user_id"), "m", "hit", "pos")


SQL_VIEWS["tscore"] = "SELECT run_id, profile, split, tick, sum(v) AS score FROM lab WHERE tick >= 1 GROUP BY ALL HAVING count(v) = (SELECT count(DISTINCT entity) FROM ev)"


def tick_scores(spark, sf):
    rows = PQ.labelled(spark, sf).where("tick >= 1").groupBy("run_id", "profile", "split", "tick").agg(F.round(F.sum("v"), 4).alias("score"), F.count("v").alias("n"))
    return rows.where(F.col("n") == V.n_entities(spark, sf)).drop("n")


@query("score_threshold", "ML2", """
WITH t AS (SELECT quantile_cont(round(score, 4), 0.05) AS lim FROM tscore WHERE split = 'train') SELECT run_id, count(*) AS n, count(*) FILTER (WHERE round(score, 4) < lim) AS n_alarm FROM tscore, t GROUP BY run_id""")
def score_threshold(spark, sf):
    rows = cut_lineage(tick_scores(spark, sf))
    lim = Q.quantiles(rows.where("split = 'train'"), [], "score", {"lim": ("linear", 0.05)})
    return rows.join(F.broadcast(lim)).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") < F.col("lim")).alias("n_alarm"))


@query("fold_score_calibration", "ML3", f"""
WITH s AS (SELECT profile, round(score, 4) AS score FROM tscore WHERE split = 'train'), t AS (SELECT f.profile, quantile_cont(s.score, 0.1) AS lim FROM (SELECT DISTINCT profile FROM s) f JOIN s ON s.profile <> f.profile GROUP BY f.profile)
SELECT profile, {r6('any_value(lim)')} AS threshold, count(*) AS n, {r6('avg(CASE WHEN score < lim THEN 1.0 ELSE 0.0 END)')} AS heldout_rate, {r6('avg(CASE WHEN score < lim THEN 1.0 ELSE 0.0 END) / 0.1')} AS honesty FROM s JOIN t USING (profile) GROUP BY profile""")
def fold_score_calibration(spark, sf):
    rows = cut_lineage(tick_scores(spark, sf).where("split = 'train'").select("profile", "score"))
    folds = rows.select("profile").distinct().agg(F.collect_set("profile").alias("_f"))  # one entry per configuration
    held = rows.join(F.broadcast(folds)).select("score", F.explode(F.array_remove("_f", F.col("profile"))).alias("profile"))
    lim = Q.quantiles(held, ["profile"], "score", {"threshold": ("linear", 0.1)})
    below = F.avg((F.col("score") < F.col("threshold")).cast("double"))
    return rows.join(lim, "profile").groupBy("profile", "threshold").agg(F.count(F.lit(1)).alias("n"), below.alias("heldout_rate"), (below / 0.1).alias("honesty"))


@query("score_dynamics", "AG61", f"""
WITH d AS (SELECT profile, abs(v - lag(v) OVER (PARTITION BY run_id, entity ORDER BY tick)) AS d FROM lab WHERE split = 'train')
SELECT profile, count(d) AS n, {r6('median(d)')} AS median, {r6('quantile_cont(d, 0.95)')} AS p95, {r6('max(d)')} AS top, {r6('max(d) / median(d)')} AS factor FROM d GROUP BY profile""")
def score_dynamics(spark, sf):
    rows = PQ.labelled(spark, sf).where("split = 'train'")
    moved = cut_lineage(C.delta(rows, ["run_id", "entity"], ["tick"], S.tick_chunk("tick"), "v", "d").select("profile", F.abs("d").alias("d")))
    per = moved.groupBy("profile").agg(F.count("d").alias("n"), F.max("d").alias("top"))
    return per.join(Q.quantiles(moved, ["profile"], "d", {"median": ("middle", 0.5), "p95": ("linear", 0.95)}), "profile").withColumn("factor", F.col("top") / F.col("median"))


@query("tail_ownership", "AG62", """
WITH t AS (SELECT quantile_cont(round(score, 4), 0.1) AS lim FROM tscore WHERE split = 'train') SELECT profile, count(*) AS n_tail, arg_min(run_id, (round(score, 4), run_id, tick)) AS lowest_run, arg_min(tick, (round(score, 4), run_id, tick)) AS lowest_tick FROM tscore, t WHERE split = 'train' AND round(score, 4) < lim GROUP BY profile""")
def tail_ownership(spark, sf):
    rows = cut_lineage(tick_scores(spark, sf).where("split = 'train'"))
    lim = Q.quantiles(rows, [], "score", {"lim": ("linear", 0.1)})
    tail = rows.join(F.broadcast(lim)).where("score < lim")
    return tail.groupBy("profile").agg(F.count(F.lit(1)).alias("n_tail"), F.min(F.struct("score", "run_id", "tick")).alias("b")).select(
        "profile", "n_tail", F.col("b.run_id").alias("lowest_run"), F.col("b.tick").alias("lowest_tick")
    )


def wide(spark, sf):
    rows = PQ.labelled(spark, sf).where("tick >= 1")
    cols = [F.max(F.when(F.col("entity") == e, F.col("v"))).alias(f"f{i}") for i, e in enumerate(V.ENTITIES)]
    full = rows.groupBy("run_id", "split", "profile", "tick").agg(*cols, F.count("v").alias("n")).where(F.col("n") == len(V.ENTITIES)).drop("n")
    return cut_lineage(full.withColumn("row", F.concat_ws(":", "run_id", "tick")))


FEATURES = [f"f{i}" for i in range(len(V.ENTITIES))]


@query("constant_columns", "ML4", """
SELECT entity, count(v) AS n, min(v) = max(v) AS constant FROM lab WHERE split = 'train' AND tick >= 1 GROUP BY entity""")
def constant_columns(spark, sf):
    rows = PQ.labelled(spark, sf).where("split = 'train' and tick >= 1")
    return rows.groupBy("entity").agg(F.count("v").alias("n"), (F.min("v") == F.max("v")).alias("constant"))


def fitted(spark, sf, trees=50, sample=128, seed=0):
    rows = wide(spark, sf)
    train = rows.where("split = 'train'")
    n = train.count()
    nodes = cut_lineage(X.fit(train, "row", FEATURES, n, trees, sample, seed))
    return rows, nodes, min(sample, n)


@query("forest_scores", "ML1")
def forest_scores(spark, sf):
    rows, nodes, sample = fitted(spark, sf)
    return X.score(rows, nodes, FEATURES, sample).select("run_id", "tick", "split", "score")


@query("forest_alarms", "ML1 ML2")
def forest_alarms(spark, sf):
    rows, nodes, sample = fitted(spark, sf)
    scored = cut_lineage(X.score(rows, nodes, FEATURES, sample))
    lim = Q.quantiles(scored.where("split = 'train'"), [], "score", {"lim": ("linear", 0.02)})
    return scored.join(F.broadcast(lim)).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") < F.col("lim")).alias("n_alarm"))


@query("forest_split_usage", "SRT3")
def forest_split_usage(spark, sf):
    _, nodes, _ = fitted(spark, sf)
    return X.split_usage(nodes, 10)


@query("forest_noise_control", "ML5")
def forest_noise_control(spark, sf):
    """The same detector on Gaussian noise with as many rows as the train part, beside the data."""
    rows, nodes, sample = fitted(spark, sf)
    train = rows.where("split = 'train'")
    n = train.count()
    noise = cut_lineage(train.select("row", *[F.randn(17 + i).alias(c) for i, c in enumerate(FEATURES)]))
    grown = cut_lineage(X.fit(noise, "row", FEATURES, n, 50, 128, 0))
    parts = [X.score(train.select("row", *FEATURES), nodes, FEATURES, sample).withColumn("arm", F.lit("data")), X.score(noise, grown, FEATURES, sample).withColumn("arm", F.lit("noise"))]
    both = cut_lineage(parts[0].unionByName(parts[1]))
    lim = Q.quantiles(both, ["arm"], "score", {"lim": ("linear", 0.02)})
    return both.join(lim, "arm").groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") < F.col("lim")).alias("n_alarm"), F.avg("score").alias("mean_score"))
