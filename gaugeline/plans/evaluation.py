"""Labels, confusion counts, incidents, release gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import stats
from gaugeline.operators import alarm as A
from gaugeline.operators import envelope as O
from gaugeline.operators import metrics as M
from gaugeline.operators import quantiles as Q
from gaugeline.operators import scan as S
from gaugeline.plans import alarm as PA
from gaugeline.plans import envelope as E
from gaugeline.plans import views as V
from gaugeline.plans.registry import query, r6
from gaugeline.plans.views import SQL_VIEWS
from gaugeline.session import cut_lineage


def frame(spark, sf):
    r = V.runs(spark, sf).where("split = 'test'").select("run_id", "grp", "fault", "inject", "revert")
    return E.scores(spark, sf).join(r, "run_id").select(
        "run_id", "tick", "grp", "fault", M.in_fault(F.col("tick"), F.col("inject"), F.col("revert")).alias("y"),
        (F.col("tick") >= 1).alias("in_eval"), "judgeable", (F.col("judgeable") & (F.col("k") > 0)).alias("alarm"),
        "k", "excess", "inject", "revert",
    )


@query("label_table", "JN2 JN3", """
SELECT run_id, tick, coalesce(tick > inject AND tick <= revert, false) AS y, tick >= 1 AS eval_primary,
 tick >= 1 AND NOT coalesce((tick > inject AND tick <= inject + 2) OR (tick > revert AND tick <= revert + 2), false) AS eval_sensitivity
FROM (SELECT DISTINCT run_id, tick FROM cells) JOIN runs USING (run_id)""")
def label_table(spark, sf):
    ticks = V.cells(spark, sf).select("run_id", "tick").distinct()
    r = V.runs(spark, sf).select("run_id", "inject", "revert")
    t, i, v = F.col("tick"), F.col("inject"), F.col("revert")
    late = t >= 1
    return ticks.join(r, "run_id").select(
        "run_id", "tick", M.in_fault(t, i, v).alias("y"), late.alias("eval_primary"), (late & ~M.in_transition(t, i, v)).alias("eval_sensitivity")
    )


@query("label_coverage", "JN1 SET2", """
WITH s AS (SELECT run_id, tick, count(*) AS n FROM cells GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT entity) FROM cells)),
l AS (SELECT run_id, unnest(range(0, n_ticks)) AS tick FROM runs)
SELECT coalesce(s.run_id, l.run_id) AS run_id, count(*) FILTER (WHERE s.tick IS NOT NULL AND l.tick IS NOT NULL) AS n_matched,
 count(*) FILTER (WHERE l.tick IS NULL) AS n_unlabelled, count(*) FILTER (WHERE s.tick IS NULL) AS n_label_only
FROM s FULL JOIN l ON s.run_id = l.run_id AND s.tick = l.tick GROUP BY 1""")
def label_coverage(spark, sf):
    cells = V.cells(spark, sf)
    whole = F.broadcast(cells.agg(F.count_distinct("entity").alias("n_all")))  # one row
    snaps = cells.groupBy("run_id", "tick").agg(F.count(F.lit(1)).alias("n")).join(whole).where("n = n_all").drop("n_all")
    labels = V.runs(spark, sf).select("run_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_ticks") - 1)).alias("tick"), F.lit(1).alias("l"))
    both = snaps.join(labels, ["run_id", "tick"], "full_outer")
    return both.groupBy("run_id").agg(
        F.count_if(F.col("n").isNotNull() & F.col("l").isNotNull()).alias("n_matched"),
        F.count_if(F.col("l").isNull()).alias("n_unlabelled"), F.count_if(F.col("n").isNull()).alias("n_label_only"),
    )


# The evaluation frame with one fault per run number: a strange group at one tick, a fault name lost or
# invented, an alarm without judgement, a row twice; the rest shows what the data itself breaks.
SQL_VIEWS["badframe"] = """SELECT run_id, tick, CASE WHEN d = 1 AND tick = 0 THEN 'X' ELSE grp END AS grp, CASE WHEN d <> 3 THEN fault WHEN grp = 'C' THEN 'degrade' END AS fault, y,
  judgeable AND NOT (d = 5 AND tick = 2) AS judgeable, alarm OR (d = 5 AND tick = 2) AS alarm FROM (SELECT *, CAST(substr(run_id, 2) AS BIGINT) % 10 AS d FROM evalframe), (SELECT unnest(range(0, 2)) AS copy) WHERE copy = 0 OR (d = 7 AND tick = 0)"""


@query("frame_violations", "JN1", """
WITH p AS (SELECT run_id, count(DISTINCT grp) AS n_grp, max(grp) AS grp, max(fault) AS fault, count(*) FILTER (WHERE y) AS n_y, max(tick) FILTER (WHERE y) - min(tick) FILTER (WHERE y) + 1 AS span,
 count(*) FILTER (WHERE alarm AND NOT judgeable) AS blind, count(*) - count(DISTINCT tick) AS again FROM badframe GROUP BY run_id)
SELECT run_id, 'group' AS kind FROM p WHERE n_grp <> 1 UNION ALL SELECT run_id, 'control_with_fault' FROM p WHERE grp = 'C' AND (n_y > 0 OR fault IS NOT NULL)
UNION ALL SELECT run_id, 'fault_missing' FROM p WHERE grp = 'F' AND fault IS NULL UNION ALL SELECT run_id, 'y_block' FROM p WHERE grp = 'F' AND (n_y = 0 OR span <> n_y)
UNION ALL SELECT run_id, 'alarm_unjudgeable' FROM p WHERE blind > 0 UNION ALL SELECT run_id, 'repeated_key' FROM p WHERE again > 0""")
def frame_violations(spark, sf):
    rows = frame(spark, sf).withColumn("d", F.substring("run_id", 2, 12).cast("bigint") % 10)
    blind = (F.col("d") == 5) & (F.col("tick") == 2)
    bad = rows.select(
        "run_id", "tick", "y", F.when((F.col("d") == 1) & (F.col("tick") == 0), "X").otherwise(F.col("grp")).alias("grp"),
        F.when(F.col("d") != 3, F.col("fault")).when(F.col("grp") == "C", "degrade").alias("fault"),
        (F.col("judgeable") & ~blind).alias("judgeable"), (F.col("alarm") | blind).alias("alarm"),
        F.explode(F.when((F.col("d") == 7) & (F.col("tick") == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return M.frame_faults(bad)


CONF = """count(*) FILTER (WHERE y AND alarm) AS tp, count(*) FILTER (WHERE NOT y AND alarm) AS fp, count(*) FILTER (WHERE y AND NOT alarm) AS fn,
 count(*) FILTER (WHERE NOT y AND NOT alarm) AS tn, count(*) FILTER (WHERE y AND NOT judgeable) AS n_unknown_positive, count(*) FILTER (WHERE NOT y AND NOT judgeable) AS n_unknown_negative"""


@query("confusion_counts", "AG24", f"SELECT {CONF} FROM evalframe WHERE in_eval")
def confusion_counts(spark, sf):
    return M.confusion(frame(spark, sf))


RATIOS = f"""{r6('tp / nullif(tp + fn, 0)')} AS recall, {r6('(tp + fn - n_unknown_positive) / nullif(tp + fn, 0)')} AS recall_ceiling, {r6('fp / nullif(fp + tn, 0)')} AS fpr,
 {r6('fp / nullif(fp + tn - n_unknown_negative, 0)')} AS fpr_judgeable_only, {r6('tp / nullif(tp + fp, 0)')} AS precision, {r6('2 * tp / nullif(2 * tp + fp + fn, 0)')} AS f1"""


@query("run_scores", "AG25", f"WITH c AS (SELECT run_id, {CONF} FROM evalframe WHERE in_eval GROUP BY run_id) SELECT *, {RATIOS} FROM c")
def run_scores(spark, sf):
    return M.scores(M.confusion(frame(spark, sf), ["run_id"]))


@query("fpr_breakdown", "AG26", f"""
WITH c AS (SELECT CASE WHEN grp = 'C' THEN 'control' ELSE 'in_fault_runs' END AS part, CASE WHEN grp = 'C' THEN run_id END AS run_id,
  count(*) FILTER (WHERE alarm) AS fp, count(*) AS n_negative, count(*) FILTER (WHERE judgeable) AS n_judgeable FROM evalframe WHERE in_eval AND NOT y
  GROUP BY GROUPING SETS ((), (CASE WHEN grp = 'C' THEN 'control' ELSE 'in_fault_runs' END), (CASE WHEN grp = 'C' THEN 'control' ELSE 'in_fault_runs' END, CASE WHEN grp = 'C' THEN run_id END)))
SELECT coalesce(part, 'all') AS part, coalesce(run_id, '-') AS run_id, max(fp) AS fp, max(n_negative) AS n_negative, {r6('max(fp) / max(n_negative)')} AS fpr, {r6('max(fp) / max(n_judgeable)')} AS fpr_judgeable_only FROM c GROUP BY 1, 2""")
def fpr_breakdown(spark, sf):
    rows = frame(spark, sf).where("in_eval and not y").select(
        F.when(F.col("grp") == "C", "control").otherwise("in_fault_runs").alias("part"),
        F.when(F.col("grp") == "C", F.col("run_id")).otherwise("-").alias("run_id"), "alarm", "judgeable",
    )
    sets = rows.rollup("part", "run_id").agg(
        F.count_if("alarm").alias("fp"), F.count(F.lit(1)).alias("n_negative"), F.count_if("judgeable").alias("n_judgeable")
    )
    named = sets.select(
        F.coalesce("part", F.lit("all")).alias("part"), F.coalesce("run_id", F.lit("-")).alias("run_id"), "fp", "n_negative",
        (F.col("fp") / F.col("n_negative")).alias("fpr"), F.try_divide(F.col("fp").cast("double"), F.col("n_judgeable")).alias("fpr_judgeable_only"),
    )
    return named.distinct()


@query("scores_by_fault", "AG27", f"""
SELECT coalesce(fault, 'all') AS fault, coalesce(run_id, 'pooled') AS run_id, count(*) FILTER (WHERE y AND alarm) AS tp, count(*) FILTER (WHERE y) AS n_positive,
 {r6('count(*) FILTER (WHERE y AND alarm) / nullif(count(*) FILTER (WHERE y), 0)')} AS recall FROM evalframe WHERE grp = 'F' AND in_eval GROUP BY ROLLUP (fault, run_id)""")
def scores_by_fault(spark, sf):
    rows = frame(spark, sf).where("grp = 'F' and in_eval")
    out = rows.rollup("fault", "run_id").agg(F.count_if(F.col("y") & F.col("alarm")).alias("tp"), F.count_if("y").alias("n_positive"))
    return out.select(
        F.coalesce("fault", F.lit("all")).alias("fault"), F.coalesce("run_id", F.lit("pooled")).alias("run_id"), "tp", "n_positive",
        F.try_divide(F.col("tp").cast("double"), F.col("n_positive")).alias("recall"),
    )


@query("base_rate", "AG23", f"""
SELECT coalesce(fault, '-') AS fault, coalesce(run_id, '-') AS run_id, count(*) AS n, count(*) FILTER (WHERE y) AS n_positive, {r6('avg(CASE WHEN y THEN 1.0 ELSE 0.0 END)')} AS rate
FROM (SELECT *, coalesce(fault, 'none') AS f2 FROM evalframe) e WHERE in_eval GROUP BY GROUPING SETS ((), (f2), (run_id))""".replace("coalesce(fault, '-') AS fault", "coalesce(f2, '-') AS fault"))
def base_rate(spark, sf):
    rows = frame(spark, sf).where("in_eval").withColumn("fault", F.coalesce("fault", F.lit("none")))
    out = rows.groupingSets([[], ["fault"], ["run_id"]], "fault", "run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("y").alias("n_positive"), F.avg(F.col("y").cast("double")).alias("rate")
    )
    return out.na.fill("-", ["fault", "run_id"])


@query("detection_delay", "AG28", "SELECT run_id, min(tick) FILTER (WHERE alarm AND in_eval) - min(tick) AS delay FROM evalframe WHERE grp = 'F' AND y GROUP BY run_id")
def detection_delay(spark, sf):
    return M.detection_delay(frame(spark, sf))


@query("delay_summary", "AG28", f"""
WITH d AS (SELECT run_id, min(tick) FILTER (WHERE alarm AND in_eval) - min(tick) AS delay FROM evalframe WHERE grp = 'F' AND y GROUP BY run_id)
SELECT count(*) AS n_incidents, count(delay) AS n_detected, count(*) - count(delay) AS n_censored, {r6('median(delay)')} AS median_delay FROM d""")
def delay_summary(spark, sf):
    d = M.detection_delay(frame(spark, sf))
    sizes = d.agg(F.count(F.lit(1)).alias("n_incidents"), F.count("delay").alias("n_detected"), (F.count(F.lit(1)) - F.count("delay")).alias("n_censored"))
    middle = Q.quantiles(d, [], "delay", {"median_delay": ("middle", 0.5)})
    return sizes.join(middle, how="left")


@query("seed_summary", "AG29", f"""
WITH c AS (SELECT run_id, {CONF} FROM evalframe WHERE in_eval GROUP BY run_id), s AS (SELECT fp / nullif(fp + tn, 0) AS v, tp / nullif(tp + fn, 0) AS w FROM c)
SELECT count(*) AS n_seeds, count(w) AS n_valid, {r6('avg(w)')} AS mean, {r6('stddev_samp(w)')} AS std, {r6('min(w)')} AS low, {r6('max(w)')} AS high, {r6('avg(v)')} AS fpr_mean, {r6('stddev_samp(v)')} AS fpr_std FROM s""")
def seed_summary(spark, sf):
    per = M.scores(M.confusion(frame(spark, sf), ["run_id"]))
    return per.agg(
        F.count(F.lit(1)).alias("n_seeds"), F.count("recall").alias("n_valid"), F.avg("recall").alias("mean"), F.stddev_samp("recall").alias("std"),
        F.min("recall").alias("low"), F.max("recall").alias("high"), F.avg("fpr").alias("fpr_mean"), F.stddev_samp("fpr").alias("fpr_std"),
    )


@query("common_judgeable", "JN17", """
SELECT e.run_id, count(*) FILTER (WHERE e.in_eval) AS n_eval, count(*) FILTER (WHERE e.in_eval AND e.judgeable AND o.ok2) AS n_common, count(*) FILTER (WHERE e.in_eval AND e.judgeable AND o.ok2 AND e.alarm) AS n_alarm
FROM evalframe e JOIN (SELECT run_id, tick, min(n) >= 2 AS ok2 FROM cells GROUP BY run_id, tick) o ON o.run_id = e.run_id AND o.tick = e.tick GROUP BY e.run_id""")
def common_judgeable(spark, sf):
    other = V.cells(spark, sf).groupBy("run_id", "tick").agg((F.min("n") >= 2).alias("ok2"))
    both = F.col("in_eval") & F.col("judgeable") & F.col("ok2")
    return frame(spark, sf).join(other, ["run_id", "tick"]).groupBy("run_id").agg(
        F.count_if("in_eval").alias("n_eval"), F.count_if(both).alias("n_common"), F.count_if(both & F.col("alarm")).alias("n_alarm")
    )


@query("split_leakage", "JN19 SET3 SRC5", """
SELECT (SELECT count(*) FROM (SELECT run_id FROM runs WHERE split = 'train' INTERSECT SELECT run_id FROM runs WHERE split = 'test')) AS shared_runs,
 (SELECT count(*) FROM (SELECT profile FROM runs WHERE split = 'train' INTERSECT SELECT profile FROM runs WHERE split = 'test')) AS shared_profiles,
 (SELECT count(DISTINCT user_id) FROM ev JOIN runs USING (run_id) WHERE split = 'train' AND user_id IN (SELECT user_id FROM ev JOIN runs USING (run_id) WHERE split = 'test')) AS shared_devices""")
def split_leakage(spark, sf):
    r = V.runs(spark, sf)
    train, test = r.where("split = 'train'"), r.where("split = 'test'")
    shared = lambda c: train.select(c).intersect(test.select(c)).agg(F.count(F.lit(1)).alias("n"))
    devices = V.ev(spark, sf).select("run_id", "user_id").distinct()
    both = devices.join(train, "run_id", "left_semi").select("user_id").intersect(devices.join(test, "run_id", "left_semi").select("user_id"))
    return (
        shared("run_id").withColumnRenamed("n", "shared_runs")
        .join(shared("profile").withColumnRenamed("n", "shared_profiles"))
        .join(both.agg(F.count(F.lit(1)).alias("shared_devices")))
    )


SQL_VIEWS["incidents"] = """SELECT r.run_id, any_value(r.fault) AS fault, min(e.tick) FILTER (WHERE t.state IN ('suspect', 'act') AND t.prev NOT IN ('suspect', 'act')) AS first_tick, max(e.k) AS max_k,
  min(c.us) FILTER (WHERE t.state IN ('suspect', 'act') AND t.prev NOT IN ('suspect', 'act')) - any_value(z.us) AS t_detect_us
  FROM runs r JOIN loads l ON l.run_id = r.run_id JOIN trace_n t ON t.user_id = l.g AND t.tick = l.rn JOIN scores e ON e.run_id = r.run_id AND e.tick = l.tick
  JOIN (SELECT run_id, tick, max(us) AS us FROM cells GROUP BY run_id, tick) c ON c.run_id = r.run_id AND c.tick = l.tick
  JOIN (SELECT run_id, tick, max(us) AS us FROM cells GROUP BY run_id, tick) z ON z.run_id = r.run_id AND z.tick = r.inject
  WHERE r.grp = 'F' AND l.tick > r.inject AND l.tick <= r.revert GROUP BY r.run_id"""


def run_trace(spark, sf):
    return A.states(PA.run_readings(spark, sf), ["run_id"], ["tick"], S.tick_chunk("tick"))


def incidents(spark, sf):
    r = V.runs(spark, sf).where("grp = 'F'").select("run_id", "fault", "inject", "revert")
    clock = V.cells(spark, sf).groupBy("run_id", "tick").agg(F.max("us").alias("us"))
    start = clock.join(r, "run_id").where("tick = inject").select("run_id", F.col("us").alias("us0"))
    rows = run_trace(spark, sf).join(r, "run_id").where("tick > inject and tick <= revert")
    rows = rows.join(E.scores(spark, sf).select("run_id", "tick", "k"), ["run_id", "tick"]).join(clock, ["run_id", "tick"]).join(start, "run_id")
    hit = F.when(F.col("entry"), F.struct("tick", "us"))
    out = rows.groupBy("run_id", "fault", "us0").agg(F.min(hit).alias("h"), F.max("k").alias("max_k"))
    return out.select("run_id", "fault", F.col("h.tick").alias("first_tick"), "max_k", (F.col("h.us") - F.col("us0")).alias("t_detect_us"))


@query("incident_table", "AG30", "SELECT run_id, fault, first_tick, max_k, t_detect_us FROM incidents")
def incident_table(spark, sf):
    return incidents(spark, sf)


@query("detection_summary", "AG31", f"""
WITH s AS (SELECT *, row_number() OVER (ORDER BY t_detect_us) - 1 AS i FROM incidents WHERE first_tick IS NOT NULL)
SELECT count(*) AS n_incidents, count(first_tick) AS n_detected, {r6('count(first_tick) / count(*)')} AS detection_rate,
 {r6('(SELECT max(t_detect_us) FROM s WHERE i = round_even(0.95 * ((SELECT count(*) FROM s) - 1), 0)) / 1000.0')} AS t_detect_p95_ms, {r6('max(t_detect_us) / 1000.0')} AS t_detect_max_ms,
 count(*) FILTER (WHERE first_tick IS NULL AND max_k > 0) AS n_censored_left, count(*) FILTER (WHERE first_tick IS NULL AND max_k = 0) AS n_censored_inside FROM incidents""")
def detection_summary(spark, sf):
    inc = cut_lineage(incidents(spark, sf))
    out = inc.agg(
        F.count(F.lit(1)).alias("n_incidents"), F.count("first_tick").alias("n_detected"),
        F.try_divide(F.count("first_tick").cast("double"), F.count(F.lit(1))).alias("detection_rate"), (F.max("t_detect_us") / 1000.0).alias("t_detect_max_ms"),
        F.count_if(F.col("first_tick").isNull() & (F.col("max_k") > 0)).alias("n_censored_left"),
        F.count_if(F.col("first_tick").isNull() & (F.col("max_k") == 0)).alias("n_censored_inside"),
    )
    p95 = Q.quantiles(inc.withColumn("ms", F.col("t_detect_us") / 1000.0), [], "ms", {"t_detect_p95_ms": ("round", 0.95)})
    return out.join(p95, how="left")


UPPER = """, b AS (SELECT n_events, at_risk, 0.0::DOUBLE AS lo, greatest(10.0, 10.0 * (n_events + 1))::DOUBLE AS hi, 0 AS step FROM t
  UNION ALL SELECT n_events, at_risk, CASE WHEN c > 0.05 THEN mid ELSE lo END AS lo, CASE WHEN c > 0.05 THEN hi ELSE mid END AS hi, step + 1 AS step
  FROM (SELECT *, (lo + hi) / 2 AS mid, (SELECT sum(exp(-(lo + hi) / 2 + i * ln((lo + hi) / 2) - lgamma(i + 1))) FROM range(0, n_events + 1) g(i)) AS c FROM b WHERE step < 200))"""


@query("false_alarm_rate", "AG32 FN3", """
WITH t AS (SELECT count(*) FILTER (WHERE t.state IN ('suspect', 'act') AND t.prev NOT IN ('suspect', 'act')) AS n_events, count(*) FILTER (WHERE t.status = 'scored' AND t.prev NOT IN ('suspect', 'act')) AS at_risk
  FROM trace_n t JOIN runs r ON r.g = t.user_id WHERE r.grp = 'C')""" + UPPER + f"""
SELECT n_events, at_risk, {r6('n_events / (at_risk / 3600.0)')} AS rate_point, {r6('hi / (at_risk / 3600.0)')} AS rate_upper, {r6('60.0 / (hi / (at_risk / 3600.0))')} AS mtbfa_lower_minutes FROM b WHERE step = 200""")
def false_alarm_rate(spark, sf):
    control = V.runs(spark, sf).where("grp = 'C'").select("run_id")
    t = run_trace(spark, sf).join(control, "run_id", "left_semi").agg(
        F.count_if("entry").alias("n_events"), F.count_if((F.col("status") == "scored") & ~F.col("prev").isin(*A.ALARM)).alias("at_risk")
    )
    hours = F.when(F.col("at_risk") > 0, F.col("at_risk") / 3600.0)
    out = t.withColumn("up", stats.poisson_upper(F.col("n_events")))
    return out.select("n_events", "at_risk", (F.col("n_events") / hours).alias("rate_point"), (F.col("up") / hours).alias("rate_upper"), (60.0 / (F.col("up") / hours)).alias("mtbfa_lower_minutes"))


SQL_VIEWS["evidence"] = """SELECT run_id, tick, CASE WHEN bool_or(ok AND rate > 350) THEN true WHEN bool_or(NOT ok) THEN NULL ELSE false END AS ev_strict,
  CASE WHEN bool_or(ok AND rate > 250) THEN true WHEN bool_or(NOT ok) THEN NULL ELSE false END AS ev_sensitive FROM cells GROUP BY run_id, tick"""


def evidence(spark, sf):
    def column(limit):
        return F.when(F.max(F.coalesce(F.col("rate") > limit, F.lit(False))), True).when(F.count("rate") < F.count(F.lit(1)), F.lit(None)).otherwise(False)

    return V.valid_rates(spark, sf).groupBy("run_id", "tick").agg(column(350).alias("ev_strict"), column(250).alias("ev_sensitive"))


@query("physical_evidence", "PRJ15", "SELECT run_id, tick, ev_strict, ev_sensitive FROM evidence")
def physical_evidence(spark, sf):
    return evidence(spark, sf)


@query("alarm_evidence", "AG33", """
SELECT run_id, count(*) AS alarm_ticks, count(*) FILTER (WHERE ev_strict = false) AS fp_strict, count(*) FILTER (WHERE ev_strict IS NULL) AS open_strict,
 count(*) FILTER (WHERE ev_sensitive = false) AS fp_sensitive, count(*) FILTER (WHERE ev_sensitive IS NULL) AS open_sensitive FROM evalframe JOIN evidence USING (run_id, tick) WHERE alarm GROUP BY run_id""")
def alarm_evidence(spark, sf):
    rows = frame(spark, sf).where("alarm").join(evidence(spark, sf), ["run_id", "tick"])
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("alarm_ticks"), F.count_if(~F.col("ev_strict")).alias("fp_strict"), F.count_if(F.col("ev_strict").isNull()).alias("open_strict"),
        F.count_if(~F.col("ev_sensitive")).alias("fp_sensitive"), F.count_if(F.col("ev_sensitive").isNull()).alias("open_sensitive"),
    )


@query("false_alarm_positions", "AG38", """
WITH f AS (SELECT *, CASE WHEN grp = 'C' THEN 'normal' WHEN tick <= inject THEN 'before' ELSE 'after' END AS place FROM evalframe WHERE alarm AND NOT y AND in_eval),
g AS (SELECT run_id, tick, tick - row_number() OVER (PARTITION BY run_id ORDER BY tick) AS isl FROM f WHERE place = 'after'),
h AS (SELECT run_id, isl, count(*) AS n FROM g GROUP BY run_id, isl)
SELECT f.run_id, count(*) AS n_false, count(*) FILTER (WHERE place = 'normal') AS n_normal, count(*) FILTER (WHERE place = 'before') AS n_before, count(*) FILTER (WHERE place = 'after') AS n_after,
 max(tick - revert) FILTER (WHERE place = 'after') AS post_span, any_value(hh.longest) AS longest FROM f LEFT JOIN (SELECT run_id, max(n) AS longest FROM h GROUP BY run_id) hh ON hh.run_id = f.run_id GROUP BY f.run_id""")
def false_alarm_positions(spark, sf):
    place = F.when(F.col("grp") == "C", "normal").when(F.col("tick") <= F.col("inject"), "before").otherwise("after")
    rows = frame(spark, sf).where("alarm and not y and in_eval").withColumn("place", place)
    after = S.islands(rows.where("place = 'after'").select("run_id", "tick"), ["run_id"], "tick")
    longest = after.groupBy("run_id", "island").agg(F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(F.max("n").alias("longest"))
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_false"), *[F.count_if(F.col("place") == p).alias(f"n_{p}") for p in ("normal", "before", "after")],
        F.max(F.when(F.col("place") == "after", F.col("tick") - F.col("revert"))).alias("post_span"),
    ).join(longest, "run_id", "left")


@query("window_excess", "AG39", f"""
SELECT run_id, {r6('max(excess)')} AS excess_max, count(*) FILTER (WHERE excess > 0) AS n_above, max(k) AS k_max, {r6('avg(excess)')} AS excess_mean FROM scores JOIN runs USING (run_id)
WHERE grp = 'F' AND tick BETWEEN inject + 1 AND revert GROUP BY run_id""")
def window_excess(spark, sf):
    return frame(spark, sf).where("grp = 'F' and y").groupBy("run_id").agg(
        F.max("excess").alias("excess_max"), F.count_if(F.col("excess") > 0).alias("n_above"), F.max("k").alias("k_max"), F.avg("excess").alias("excess_mean")
    )


@query("release_gates", "AG36 AG66", """
WITH d AS (SELECT count(first_tick) / count(*) AS rate, count(*) AS n FROM incidents),
f AS (SELECT count(*) FILTER (WHERE alarm AND NOT y) / nullif(count(*) FILTER (WHERE NOT y), 0) AS fpr, count(*) AS n FROM evalframe WHERE in_eval),
m AS (SELECT median(k) AS km, count(*) AS n FROM evalframe WHERE judgeable AND grp = 'C'),
v AS (SELECT 'S1' AS target, CASE WHEN n >= 1 THEN rate END AS value, '>=' AS op, 0.875 AS goal FROM d UNION ALL SELECT 'S2', CASE WHEN n >= 3 THEN fpr END, '<=', 0.05 FROM f
 UNION ALL SELECT 'S3', CASE WHEN n >= 1000000000 THEN km END, '<=', 1.0 FROM m UNION ALL SELECT 'S4', km, '==', 0.0 FROM m)
SELECT target, (round(CAST(value AS DOUBLE), 6) + 0.0) AS value, CASE WHEN value IS NULL THEN 'NO_DATA' WHEN op = '>=' AND value >= goal OR op = '<=' AND value <= goal OR op = '==' AND value = goal THEN 'PASS' ELSE 'FAIL' END AS verdict FROM v""")
def release_gates(spark, sf):
    inc = incidents(spark, sf).agg(F.try_divide(F.count("first_tick").cast("double"), F.count(F.lit(1))).alias("v"), F.count(F.lit(1)).alias("n"))
    f = cut_lineage(frame(spark, sf))
    fpr = f.where("in_eval").agg(F.try_divide(F.count_if(F.col("alarm") & ~F.col("y")).cast("double"), F.count_if(~F.col("y"))).alias("v"), F.count(F.lit(1)).alias("n"))
    mid = Q.quantiles(f.where("judgeable and grp = 'C'"), [], "k", {"v": ("linear", 0.5)}, count_as="n")
    parts = [(inc, "S1", 1, ">=", 0.875), (fpr, "S2", 3, "<=", 0.05), (mid, "S3", 10**9, "<=", 1.0), (mid, "S4", 0, "==", 0.0)]
    rows = None
    for part, target, least, op, goal in parts:
        one = part.select(F.lit(target).alias("target"), F.when(F.col("n") >= least, F.col("v")).alias("value"), F.lit(op).alias("op"), F.lit(goal).alias("goal"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("target", "value", M.verdict(F.col("op"), F.col("value"), F.col("goal")).alias("verdict"))


@query("gate_decision", "AG36", """
WITH g AS (SELECT run_id, count(*) FILTER (WHERE alarm AND NOT y) = 0 AS clean, CASE WHEN count(*) FILTER (WHERE y) > 0 THEN count(*) FILTER (WHERE y AND alarm) > 0 END AS seen FROM evalframe WHERE in_eval GROUP BY run_id)
SELECT coalesce(bool_and(coalesce(clean, false)), false) AS g1, coalesce(bool_and(coalesce(seen, false)), false) AS g2, coalesce(bool_and(coalesce(clean, false) AND coalesce(seen, false)), false) AS released FROM g""")
def gate_decision(spark, sf):
    per = frame(spark, sf).where("in_eval").groupBy("run_id").agg(
        (F.count_if(F.col("alarm") & ~F.col("y")) == 0).alias("clean"), F.when(F.count_if("y") > 0, F.count_if(F.col("y") & F.col("alarm")) > 0).alias("seen")
    )
    return per.agg(M.all_true(F.col("clean")).alias("g1"), M.all_true(F.col("seen")).alias("g2"), M.all_true(F.col("clean") & F.col("seen")).alias("released"))


@query("report_completeness", "JN23", """
WITH grid AS (SELECT run_id, c AS channel FROM runs CROSS JOIN (VALUES ('link-click'), ('link-error'), ('link-other')) v(c)),
cell AS (SELECT run_id, entity AS channel, count(*) AS n FROM cells WHERE entity IN ('link-click', 'link-error', 'link-view') GROUP BY ALL)
SELECT coalesce(grid.channel, cell.channel) AS channel, count(*) FILTER (WHERE cell.n IS NULL) AS n_missing, count(*) FILTER (WHERE grid.run_id IS NULL) AS n_extra, count(*) FILTER (WHERE grid.run_id IS NOT NULL AND cell.n IS NOT NULL) AS n_filled
FROM grid FULL JOIN cell ON grid.run_id = cell.run_id AND grid.channel = cell.channel GROUP BY 1""")
def report_completeness(spark, sf):
    wanted = F.explode(F.array(*[F.lit(c) for c in ("link-click", "link-error", "link-other")])).alias("channel")
    grid = V.runs(spark, sf).select("run_id", wanted, F.lit(1).alias("g"))
    cell = V.cells(spark, sf).where(F.col("entity").isin("link-click", "link-error", "link-view")).groupBy("run_id", F.col("entity").alias("channel")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(cell, ["run_id", "channel"], "full_outer").groupBy("channel").agg(
        F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.col("g").isNull()).alias("n_extra"), F.count_if(F.col("n").isNotNull() & F.col("g").isNotNull()).alias("n_filled")
    )


@query("extremes_without_run", "AG67", f"""
WITH m AS (SELECT r.run_id AS excluded, entity, max(rate) AS hi FROM cells c JOIN runs r ON r.run_id <> c.run_id AND r.split = 'train' JOIN runs q ON q.run_id = c.run_id AND q.split = 'train' WHERE ok GROUP BY ALL)
SELECT excluded, entity, {r6('m.hi')} AS hi, {r6('b.hi - m.hi')} AS drop FROM m JOIN (SELECT entity, max(rate) AS hi FROM cells JOIN runs USING (run_id) WHERE ok AND split = 'train' GROUP BY entity) b USING (entity)""")
def extremes_without_run(spark, sf):
    cells = V.valid_rates(spark, sf).join(V.runs(spark, sf).where("split = 'train'").select("run_id"), "run_id", "left_semi")
    return O.extremes_without(cells, "run_id", "entity", "rate").withColumnRenamed("run_id", "excluded")


@query("first_alarm_tick", "AG68", f"SELECT run_id, min(tick) FILTER (WHERE alarm) AS first_alarm, count(*) FILTER (WHERE alarm) AS n_alarm, {r6('max(k)')} AS k_top FROM evalframe GROUP BY run_id")
def first_alarm_tick(spark, sf):
    return frame(spark, sf).groupBy("run_id").agg(
        F.min(F.when(F.col("alarm"), F.col("tick"))).alias("first_alarm"), F.count_if("alarm").alias("n_alarm"), F.max("k").cast("double").alias("k_top")
    )


@query("phase_variants", "ML11", f"""
WITH v AS (SELECT run_id, tick, y, in_eval, judgeable, unnest(['k0', 'k1', 'k2']) AS variant, unnest([0, 1, 2]) AS lim, k FROM evalframe),
c AS (SELECT variant, count(*) FILTER (WHERE y AND judgeable AND k > lim) AS tp, count(*) FILTER (WHERE NOT y AND judgeable AND k > lim) AS fp, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM v WHERE in_eval GROUP BY variant)
SELECT variant, tp, fp, {r6('tp / nullif(p, 0)')} AS recall, {r6('fp / nullif(n, 0)')} AS fpr FROM c""")
def phase_variants(spark, sf):
    kinds = F.explode(F.array(*[F.struct(F.lit(f"k{i}").alias("variant"), F.lit(i).alias("lim")) for i in range(3)])).alias("_v")
    rows = frame(spark, sf).select("run_id", "tick", "y", "in_eval", "judgeable", "k", kinds).select("*", "_v.variant", "_v.lim")
    scored = M.scores(M.confusion(rows.withColumn("alarm", F.col("judgeable") & (F.col("k") > F.col("lim"))), ["variant"]))
    return scored.select("variant", "tp", "fp", "recall", "fpr")
