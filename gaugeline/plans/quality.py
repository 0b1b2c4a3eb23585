"""Missingness, feature audit, run gates, aggregates and flow balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import stats
from gaugeline.operators import conservation as K
from gaugeline.operators import metrics as M
from gaugeline.operators import quality as U
from gaugeline.operators import quantiles as Q
from gaugeline.operators import scan as S
from gaugeline.plans import views as V
from gaugeline.plans.registry import query, r6
from gaugeline.plans.views import SQL_VIEWS
from gaugeline.session import cut_lineage

SQL_VIEWS["lab"] = """SELECT c.*, CASE WHEN ok THEN rate END AS v, profile, split, grp, inject, revert, coalesce(tick > inject AND tick <= revert, false) AS y FROM cells c JOIN runs USING (run_id)"""


def labelled(spark, sf):
    r = V.runs(spark, sf).select("run_id", "profile", "split", "grp", "inject", "revert")
    rows = V.valid_rates(spark, sf).withColumnRenamed("rate", "v").join(r, "run_id")
    return rows.withColumn("y", M.in_fault(F.col("tick"), F.col("inject"), F.col("revert")))


WILSON = """(({k} / {n}::DOUBLE + 3.8416 / (2 * {n})) {s} 1.96 * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + 3.8416 / (4.0 * {n} * {n}))) / (1 + 3.8416 / {n})"""


@query("missing_by_profile", "AG13 FN1", f"""
WITH t AS (SELECT profile, run_id, tick, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS m FROM lab GROUP BY ALL),
p AS (SELECT profile, count(*) AS n_rows, count(*) FILTER (WHERE m > 0) AS rows_missing, CAST(sum(n) AS BIGINT) AS n_cells, CAST(sum(m) AS BIGINT) AS cells_missing FROM t GROUP BY profile)
SELECT *, {r6('100.0 * rows_missing / n_rows')} AS pct_rows, {r6('100.0 * cells_missing / n_cells')} AS pct_cells,
 {r6('100 * greatest(0.0, ' + WILSON.format(k='cells_missing', n='n_cells', s='-') + ')')} AS ci_low, {r6('100 * least(1.0, ' + WILSON.format(k='cells_missing', n='n_cells', s='+') + ')')} AS ci_high FROM p""")
def missing_by_profile(spark, sf):
    return U.missing_by(labelled(spark, sf), ["profile"], ["run_id", "tick"], "v")


@query("missing_reasons", "AG14", """
SELECT profile, entity, CASE WHEN tick = 0 THEN 'warmup' WHEN n = 1 THEN 'unavailable' ELSE 'counter_reset' END AS reason, count(*) AS n FROM lab WHERE v IS NULL GROUP BY ALL""")
def missing_reasons(spark, sf):
    reason = F.when(F.col("tick") == 0, "warmup").when(F.col("n") == 1, "unavailable").otherwise("counter_reset")
    return labelled(spark, sf).where("v is null").groupBy("profile", "entity", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("missing_positions", "AG15", """
SELECT profile, count(DISTINCT (run_id, tick)) AS n_bad, min(tick) AS first_bad, max(tick) AS last_bad, max(tick) < 1 AS all_in_head, count(DISTINCT tick) AS n_positions FROM lab WHERE v IS NULL GROUP BY profile""")
def missing_positions(spark, sf):
    bad = labelled(spark, sf).where("v is null").groupBy("profile", "tick").agg(F.count_distinct("run_id").alias("n"))
    return bad.groupBy("profile").agg(
        F.sum("n").alias("n_bad"), F.min("tick").alias("first_bad"), F.max("tick").alias("last_bad"), (F.max("tick") < 1).alias("all_in_head"),
        F.count(F.lit(1)).alias("n_positions"),
    )


@query("warmup_share", "AG16", f"""
SELECT profile, count(*) FILTER (WHERE v IS NULL) AS n_missing, count(*) FILTER (WHERE v IS NULL AND tick < 1) AS n_in_warmup, {r6('count(*) FILTER (WHERE v IS NULL AND tick < 1) / nullif(count(*) FILTER (WHERE v IS NULL), 0)')} AS share,
 count(*) FILTER (WHERE v IS NULL AND y AND tick >= 1) AS n_in_fault FROM lab GROUP BY profile""")
def warmup_share(spark, sf):
    """How much of the missingness the warm-up explains, and what is left inside faults."""
    missing, early = F.col("v").isNull(), F.col("tick") < 1
    out = labelled(spark, sf).groupBy("profile").agg(
        F.count_if(missing).alias("n_missing"), F.count_if(missing & early).alias("n_in_warmup"), F.count_if(missing & F.col("y") & ~early).alias("n_in_fault"))
    return out.withColumn("share", F.try_divide(F.col("n_in_warmup").cast("double"), F.col("n_missing").cast("double")))


@query("missing_mechanism", "AG16 FN2", f"""
WITH s AS (SELECT p, b, y, v, tick FROM lab CROSS JOIN (VALUES ('raw', 0), ('post_warmup', 1)) t(p, b) WHERE tick >= b),
c AS (SELECT p AS part, count(*) FILTER (WHERE y AND v IS NULL) AS a, count(*) FILTER (WHERE y AND v IS NOT NULL) AS b, count(*) FILTER (WHERE NOT y AND v IS NULL) AS c, count(*) FILTER (WHERE NOT y AND v IS NOT NULL) AS d FROM s GROUP BY p),
w AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS k FROM c),
x AS (SELECT *, lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(c + d - (a + c - k) + 1) AS lw,
  lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1) + lgamma(c + d + 1) - lgamma(c + 1) - lgamma(d + 1) AS lo, lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1) AS ln FROM w)
SELECT part, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, {r6('100.0 * any_value(a) / nullif(any_value(a + b), 0)')} AS pct_fault, {r6('100.0 * any_value(c) / nullif(any_value(c + d), 0)')} AS pct_normal,
 {r6('least(1.0, sum(CASE WHEN lw <= lo + 1e-9 THEN exp(lw - ln) END))')} AS p FROM x GROUP BY part""")
def missing_mechanism(spark, sf):
    parts = F.explode(F.array(F.struct(F.lit("raw").alias("part"), F.lit(0).alias("b")), F.struct(F.lit("post_warmup").alias("part"), F.lit(1).alias("b")))).alias("_p")
    rows = labelled(spark, sf).select("tick", "y", "v", parts).where("tick >= _p.b").withColumn("part", F.col("_p.part"))
    tables = U.two_by_two(rows, ["part"], "y", "v")
    p = stats.fisher_two_sided(tables, ["part"], "a", "b", "c", "d")
    share = lambda x, y: F.try_divide(100.0 * F.col(x), (F.col(x) + F.col(y)).cast("double"))
    return tables.withColumn("pct_fault", share("a", "b")).withColumn("pct_normal", share("c", "d")).join(p, "part")


@query("feature_audit", "AG17 AG18 AG19 SRT2", f"""
WITH r AS (SELECT entity, v, y, rank() OVER (PARTITION BY entity ORDER BY v) + (count(*) OVER (PARTITION BY entity, v) - 1) / 2.0 AS rk FROM lab WHERE v IS NOT NULL),
a AS (SELECT entity, (sum(rk) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)) AS auc FROM r GROUP BY entity),
m AS (SELECT entity, 100.0 * count(*) FILTER (WHERE v IS NULL) / count(*) AS pct_null, count(DISTINCT v) AS n_distinct, count(v) FILTER (WHERE NOT y) AS n_normal, avg(v) FILTER (WHERE NOT y) AS mean_normal, stddev_samp(v) FILTER (WHERE NOT y) AS std_normal,
 count(v) FILTER (WHERE y) AS n_fault, avg(v) FILTER (WHERE y) AS mean_fault, stddev_samp(v) FILTER (WHERE y) AS std_fault FROM lab GROUP BY entity),
f AS (SELECT *, abs(auc - 0.5) * 2 AS auc_dist, abs(mean_fault - mean_normal) / sqrt(((n_normal - 1) * std_normal ** 2 + (n_fault - 1) * std_fault ** 2) / (n_normal + n_fault - 2)) AS d_pooled FROM m LEFT JOIN a USING (entity))
SELECT entity, {r6('pct_null')} AS pct_null, n_distinct, n_normal, {r6('mean_normal')} AS mean_normal, {r6('std_normal')} AS std_normal, n_fault, {r6('mean_fault')} AS mean_fault, {r6('std_fault')} AS std_fault, {r6('auc')} AS auc, {r6('auc_dist')} AS auc_dist, {r6('d_pooled')} AS d_pooled,
 CASE WHEN pct_null > 50 OR n_distinct <= 1 THEN 'drop' WHEN auc_dist IS NULL OR auc_dist < 0.10 THEN 'question' ELSE 'keep' END AS decision FROM f""")
def feature_audit(spark, sf):
    return U.audit(labelled(spark, sf), "entity", "v", "y").orderBy("decision", F.desc_nulls_last("auc_dist"))


@query("signal_separation", "AG20", f"""
WITH s AS (SELECT run_id, entity, count(v) FILTER (WHERE tick >= 1 AND tick <= inject) AS nb, count(v) FILTER (WHERE tick > inject + 1 AND tick <= revert) AS nf, avg(v) FILTER (WHERE tick >= 1 AND tick <= inject) AS mb, avg(v) FILTER (WHERE tick > inject + 1 AND tick <= revert) AS mf,
 stddev_pop(v) FILTER (WHERE tick >= 1 AND tick <= inject) AS sd FROM lab WHERE grp = 'F' GROUP BY ALL),
p AS (SELECT run_id, entity, CASE WHEN nb >= 3 AND nf >= 3 THEN abs(mf - mb) / greatest(sd, 10.0) END AS sep FROM s)
SELECT run_id, {r6('max(sep)')} AS max_separation, count(sep) AS n_links, coalesce(max(sep) >= 1.0, false) AS signal_present FROM p GROUP BY run_id""")
def signal_separation(spark, sf):
    rows = labelled(spark, sf).where("grp = 'F'")
    before = (F.col("tick") >= 1) & (F.col("tick") <= F.col("inject"))
    during = (F.col("tick") > F.col("inject") + 1) & (F.col("tick") <= F.col("revert"))
    per = U.separation(rows, ["run_id", "entity"], "v", during, before, 10.0)
    return per.groupBy("run_id").agg(
        F.max("separation").alias("max_separation"), F.count("separation").alias("n_links"), F.coalesce(F.max("separation") >= 1.0, F.lit(False)).alias("signal_present")
    )


# Gates look at more than ticks: the collector's version (one event in 1 999 has another), links seen down
# (k = 49), and whether the fault moved any entity's mean by more than half of its spread before.
SQL_VIEWS["gate_ev"] = """SELECT run_id, count(DISTINCT event_id % 1999 = 7) AS n_versions, coalesce(bool_or(k = 49), false) AS any_down, coalesce(bool_or(k = 49 AND tick > inject AND tick <= revert), false) AS down_in_fault
  FROM ev JOIN runs USING (run_id, g) GROUP BY run_id"""
SQL_VIEWS["gate_sig"] = """SELECT run_id, max(abs(m1 - m0) / greatest(s0, 1e-6)) AS sep FROM (SELECT run_id, entity, avg(v) FILTER (WHERE tick >= 1 AND tick <= inject) AS m0, stddev_pop(v) FILTER (WHERE tick >= 1 AND tick <= inject) AS s0,
  avg(v) FILTER (WHERE tick > inject AND tick <= revert) AS m1 FROM lab WHERE inject IS NOT NULL GROUP BY run_id, entity) GROUP BY run_id"""


@query("run_gates", "AG21", """
WITH t AS (SELECT run_id, tick, max(us) AS us, count(*) AS n, count(v) AS nv, any_value(grp) AS grp, any_value(fault) AS fault, any_value(inject) AS inject, any_value(revert) AS revert FROM lab JOIN (SELECT run_id, fault FROM runs) f USING (run_id) GROUP BY run_id, tick),
o AS (SELECT *, row_number() OVER w - 1 AS i, lag(us) OVER w AS pus FROM t WINDOW w AS (PARTITION BY run_id ORDER BY tick)),
g AS (SELECT run_id, any_value(grp) AS grp, any_value(fault) AS fault, count(*) AS n_snapshots, bool_and(i = tick) AS seq, abs(count(*) - 60) <= 1 AS cnt, coalesce(bool_and(us > pus), true) AS mono, min(n) = (SELECT count(DISTINCT entity) FROM ev) AS present,
 coalesce(sum(n - nv) FILTER (WHERE inject IS NULL OR tick <= inject) / sum(n) FILTER (WHERE inject IS NULL OR tick <= inject) < 0.05, false) AS valid, coalesce(any_value(revert) < count(*), any_value(grp) = 'C') AS ev FROM o GROUP BY run_id)
SELECT run_id, n_snapshots, concat_ws(',', CASE WHEN NOT seq THEN 'ticks_ok' END, CASE WHEN NOT cnt THEN 'count_ok' END, CASE WHEN NOT mono THEN 'monotonic' END, CASE WHEN NOT present THEN 'links_present' END, CASE WHEN NOT valid THEN 'rate_invalid_ok' END, CASE WHEN NOT ev THEN 'events_ok' END,
 CASE WHEN n_versions <> 1 THEN 'version_uniform' END, CASE WHEN grp = 'F' AND NOT coalesce(sep > 0.5, false) THEN 'signal_present' END, CASE WHEN fault = 'admin_down' AND NOT down_in_fault THEN 'down_observed' END, CASE WHEN grp = 'C' AND any_down THEN 'no_unexpected_down' END) AS failed_gates
FROM g JOIN gate_ev USING (run_id) LEFT JOIN gate_sig USING (run_id)""")
def run_gates(spark, sf):
    cells = cut_lineage(labelled(spark, sf).join(V.runs(spark, sf).select("run_id", "fault"), "run_id"))
    ticks = cells.groupBy("run_id", "tick", "grp", "fault", "inject", "revert").agg(F.max("us").alias("us"), F.count(F.lit(1)).alias("n"), F.count("v").alias("nv"))
    told = S.scan(ticks, ["run_id"], ["tick"], S.tick_chunk("tick"), i=S.count(before=True), p=S.previous(F.col("us")))
    quiet = F.col("inject").isNull() | (F.col("tick") <= F.col("inject"))
    per = told.groupBy("run_id", "grp", "fault", "revert").agg(
        F.count(F.lit(1)).alias("n_snapshots"), F.bool_and(F.col("i") == F.col("tick")).alias("seq"), F.bool_and(F.coalesce(F.col("us") > F.col("p"), F.lit(True))).alias("mono"),
        (F.min("n") == V.n_entities(spark, sf)).alias("present"), F.try_divide(F.sum(F.when(quiet, F.col("n") - F.col("nv"))).cast("double"), F.sum(F.when(quiet, F.col("n")))).alias("bad"),
    )
    before, during = (F.col("tick") >= 1) & (F.col("tick") <= F.col("inject")), (F.col("tick") > F.col("inject")) & (F.col("tick") <= F.col("revert"))
    moved = cells.where("inject is not null").groupBy("run_id", "entity").agg(
        F.avg(F.when(before, F.col("v"))).alias("m0"), F.stddev_pop(F.when(before, F.col("v"))).alias("s0"), F.avg(F.when(during, F.col("v"))).alias("m1"))
    signal = moved.groupBy("run_id").agg(F.max(F.abs(F.col("m1") - F.col("m0")) / F.greatest("s0", F.lit(1e-6))).alias("sep"))
    down, span = F.col("k") == 49, V.runs(spark, sf).select("run_id", "inject", "revert")
    seen = V.ev(spark, sf).join(span, "run_id").groupBy("run_id").agg(
        F.count_distinct(F.col("event_id") % 1999 == 7).alias("n_versions"), F.coalesce(F.bool_or(down), F.lit(False)).alias("any_down"), F.coalesce(F.bool_or(down & during), F.lit(False)).alias("down_in_fault"))
    per = per.join(seen, "run_id").join(signal, "run_id", "left")
    gates = {
        "ticks_ok": F.col("seq"), "count_ok": F.abs(F.col("n_snapshots") - 60) <= 1, "monotonic": F.col("mono"), "links_present": F.col("present"),
        "rate_invalid_ok": F.col("bad") < 0.05, "events_ok": F.coalesce(F.col("revert") < F.col("n_snapshots"), F.col("grp") == "C"),
        "version_uniform": F.col("n_versions") == 1, "signal_present": (F.col("grp") != "F") | F.coalesce(F.col("sep") > 0.5, F.lit(False)),
        "down_observed": ~F.col("fault").eqNullSafe(F.lit("admin_down")) | F.col("down_in_fault"), "no_unexpected_down": (F.col("grp") != "C") | ~F.col("any_down"),
    }
    return per.select("run_id", "n_snapshots", U.failed(gates).alias("failed_gates"))


@query("client_traffic_gate", "AG22", f"""
WITH w AS (SELECT run_id, entity, v FROM lab WHERE tick >= 1 AND (inject IS NULL OR tick <= inject)),
o AS (SELECT run_id, entity, v, row_number() OVER (PARTITION BY run_id, entity ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY run_id, entity) AS n FROM w WHERE v IS NOT NULL)
SELECT run_id, entity, count(*) AS n_ticks, {r6('count(*) FILTER (WHERE v >= 50) / count(*)')} AS frac_ok, {r6('min(v)')} AS min_rate, {r6('(SELECT v FROM o WHERE o.run_id = w.run_id AND o.entity = w.entity AND i = n // 2)')} AS upper_median,
 count(*) FILTER (WHERE v >= 50) / count(*) >= 0.9 AS gate_ok FROM w GROUP BY run_id, entity""")
def client_traffic_gate(spark, sf):
    rows = labelled(spark, sf).where("tick >= 1 and (inject is null or tick <= inject)")
    good = F.count_if(F.col("v") >= 0.5 * 100) / F.count(F.lit(1))
    per = rows.groupBy("run_id", "entity").agg(F.count(F.lit(1)).alias("n_ticks"), good.alias("frac_ok"), F.min("v").alias("min_rate"), (good >= 0.9).alias("gate_ok"))
    return per.join(Q.quantiles(rows, ["run_id", "entity"], "v", {"upper_median": ("upper_median", 0.5)}), ["run_id", "entity"], "left")


@query("capture_summary", "AG69", f"""
SELECT run_id, entity, {r6('avg(v)')} AS mean, {r6('stddev_pop(v)')} AS std_pop, count(v) AS n_valid, {r6('max(v)')} AS top, {r6('median(v)')} AS median FROM lab WHERE tick >= 1 GROUP BY run_id, entity""")
def capture_summary(spark, sf):
    rows = labelled(spark, sf).where("tick >= 1")
    per = rows.groupBy("run_id", "entity").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std_pop"), F.count("v").alias("n_valid"), F.max("v").alias("top"))
    return per.join(Q.quantiles(rows, ["run_id", "entity"], "v", {"median": ("linear", 0.5)}), ["run_id", "entity"], "left")


@query("tick_aggregates", "AG1", f"""
SELECT run_id, tick, {r6('max(v)')} AS loss_max, count(*) FILTER (WHERE v > 200) AS n_above, count(v) AS n_measured, count(*) FILTER (WHERE v < 20) AS links_down, count(*) AS n_states FROM lab GROUP BY run_id, tick""")
def tick_aggregates(spark, sf):
    return labelled(spark, sf).groupBy("run_id", "tick").agg(
        F.max("v").alias("loss_max"), F.count_if(F.col("v") > 200).alias("n_above"), F.count("v").alias("n_measured"),
        F.count_if(F.col("v") < 20).alias("links_down"), F.count(F.lit(1)).alias("n_states"),
    )


@query("scaled_extremes", "AG2", f"""
WITH s AS (SELECT entity, avg(v) AS mu, CASE WHEN stddev_samp(v) > 0 THEN stddev_samp(v) ELSE 1.0 END AS sd FROM lab WHERE split = 'train' AND tick >= 1 GROUP BY entity)
SELECT run_id, tick, {r6('max(abs((v - mu) / sd))')} AS absz_max, count(*) FILTER (WHERE abs((v - mu) / sd) > 3) AS n_above_3 FROM lab JOIN s USING (entity) GROUP BY run_id, tick""")
def scaled_extremes(spark, sf):
    rows = labelled(spark, sf)
    sd = F.stddev_samp("v")
    scaler = rows.where("split = 'train' and tick >= 1").groupBy("entity").agg(F.avg("v").alias("mu"), F.when(sd > 0, sd).otherwise(1.0).alias("sd"))
    z = F.abs((F.col("v") - F.col("mu")) / F.col("sd"))
    return rows.join(scaler, "entity").groupBy("run_id", "tick").agg(F.max(z).alias("absz_max"), F.count_if(z > 3).alias("n_above_3"))


@query("masked_rates", "PRJ5 PRJ3", "SELECT entity, count(*) AS n_cells, count(*) FILTER (WHERE NOT ok) AS n_masked FROM cells GROUP BY entity")
def masked_rates(spark, sf):
    flagged = V.cells(spark, sf).withColumn("flag", F.when(F.col("ok"), True))
    masked = U.mask_invalid(flagged, ["rate"], "flag")
    return masked.groupBy("entity").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("rate").isNull()).alias("n_masked"))


@query("missing_policy", "PRJ6", """
WITH p AS (SELECT run_id, tick, split, count(*) FILTER (WHERE v IS NULL) AS n_missing FROM lab WHERE tick >= 1 GROUP BY ALL)
SELECT run_id, tick, n_missing FROM p WHERE NOT (split = 'train' AND n_missing > 0)""")
def missing_policy(spark, sf):
    rows = labelled(spark, sf).where("tick >= 1").groupBy("run_id", "tick", "split").agg(F.count_if(F.col("v").isNull()).alias("n_missing"))
    return rows.where(~((F.col("split") == "train") & (F.col("n_missing") > 0))).select("run_id", "tick", "n_missing")


# Fixed incidence of the two switches of the view (switch, column, side).
INCIDENCE = (
    ("S0", "link-click", "in"), ("S0", "link-purchase", "out"), ("S0", "link-signup", "out"), ("S0", "link-view", "in"),
    ("S1", "link-error", "in"), ("S1", "link-signup", "in"), ("S1", "link-view", "out"),
)
INC_SQL = "(VALUES " + ", ".join(str(row) for row in INCIDENCE) + ") i(switch, entity, side)"
SQL_VIEWS["resid"] = f"""SELECT run_id, tick, switch, CASE WHEN count(v) = max(need) THEN (sum(CASE WHEN side = 'in' THEN v ELSE 0 END) - sum(CASE WHEN side = 'out' THEN v ELSE 0 END)) / greatest(sum(CASE WHEN side = 'in' THEN v ELSE 0 END), 10.0) END AS r
  FROM lab JOIN (SELECT *, count(*) OVER (PARTITION BY switch) AS need FROM {INC_SQL}) x USING (entity) GROUP BY run_id, tick, switch"""
SQL_VIEWS["worst_r"] = """SELECT run_id, tick, count(r) = 2 AS judgeable, CASE WHEN count(r) = 2 THEN max(r) END AS r_max, CASE WHEN count(r) = 2 THEN min(switch ORDER BY switch) FILTER (WHERE r = mx) END AS argmax_switch
  FROM (SELECT *, max(r) OVER (PARTITION BY run_id, tick) AS mx FROM resid) GROUP BY run_id, tick"""


def incidence(spark):
    return spark.createDataFrame(INCIDENCE, "switch string, entity string, side string")


def worst_residual(spark, sf):
    per = K.residuals(labelled(spark, sf), incidence(spark), ["run_id", "tick"], "entity", "v", 10.0)
    return K.worst(per, ["run_id", "tick"], 2)


@query("switch_residuals", "AG10", f"SELECT run_id, tick, judgeable, {r6('r_max')} AS r_max, argmax_switch FROM worst_r")
def switch_residuals(spark, sf):
    return worst_residual(spark, sf)


@query("residual_calibration", "AG11", f"""
SELECT profile, switch, {r6('max(r)')} AS r_top, {r6('median(r)')} AS r_median, {r6('stddev_samp(r)')} AS r_std, count(r) AS n, count(*) FILTER (WHERE r < 0) AS n_negative FROM resid JOIN runs USING (run_id) WHERE split = 'train' AND tick >= 1 GROUP BY profile, switch""")
def residual_calibration(spark, sf):
    r = V.runs(spark, sf).where("split = 'train'").select("run_id", "profile")
    per = K.residuals(labelled(spark, sf).drop("profile"), incidence(spark), ["run_id", "tick"], "entity", "v", 10.0).where("tick >= 1").join(r, "run_id")
    stats_ = per.groupBy("profile", "switch").agg(F.max("r").alias("r_top"), F.stddev_samp("r").alias("r_std"), F.count("r").alias("n"), F.count_if(F.col("r") < 0).alias("n_negative"))
    return stats_.join(Q.quantiles(per, ["profile", "switch"], "r", {"r_median": ("linear", 0.5)}), ["profile", "switch"], "left")


@query("residual_alarms", "AG12", f"""
WITH t AS (SELECT max(r_max) AS lim FROM worst_r JOIN runs USING (run_id) WHERE split = 'train' AND tick >= 1)
SELECT run_id, count(*) FILTER (WHERE judgeable AND r_max > lim) AS n_alarm, count(*) FILTER (WHERE judgeable) AS n_judgeable FROM worst_r, t GROUP BY run_id""")
def residual_alarms(spark, sf):
    w = worst_residual(spark, sf)
    train = V.runs(spark, sf).where("split = 'train'").select("run_id")
    lim = w.where("tick >= 1").join(train, "run_id", "left_semi").agg(F.max("r_max").alias("lim"))
    out = w.join(F.broadcast(lim))  # one row
    return out.groupBy("run_id").agg(F.count_if(K.alarm(F.col("r_max"), F.col("lim"))).alias("n_alarm"), F.count_if("judgeable").alias("n_judgeable"))


@query("residual_trace", "AG68", f"""
WITH t AS (SELECT max(r_max) AS lim FROM worst_r JOIN runs USING (run_id) WHERE split = 'train' AND tick >= 1),
x AS (SELECT w.run_id, w.tick, r_max, argmax_switch, r_max > lim AS alarm, s.k FROM worst_r w CROSS JOIN t JOIN scores s ON s.run_id = w.run_id AND s.tick = w.tick JOIN runs r ON r.run_id = w.run_id WHERE r.split = 'test' AND w.judgeable AND s.judgeable AND w.tick >= 1)
SELECT run_id, tick, {r6('r_max')} AS r_max, argmax_switch, alarm, k, min(tick) FILTER (WHERE alarm) OVER (PARTITION BY run_id) AS first_alarm FROM x""")
def residual_trace(spark, sf):
    """Every scored tick of the test runs with its residual, and the run's first residual alarm."""
    from gaugeline.plans import envelope as E

    w, split = cut_lineage(worst_residual(spark, sf)), V.runs(spark, sf).select("run_id", "split")
    lim = w.where("tick >= 1").join(split.where("split = 'train'"), "run_id", "left_semi").agg(F.max("r_max").alias("lim"))
    scored = E.scores(spark, sf).where("judgeable").select("run_id", "tick", "k")
    rows = w.where("judgeable and tick >= 1").join(split.where("split = 'test'"), "run_id", "left_semi").join(scored, ["run_id", "tick"]).join(F.broadcast(lim))  # one row
    rows = cut_lineage(rows.select("run_id", "tick", "r_max", "argmax_switch", K.alarm(F.col("r_max"), F.col("lim")).alias("alarm"), "k"))
    first = rows.where("alarm").groupBy("run_id").agg(F.min("tick").alias("first_alarm"))
    return rows.join(first, "run_id", "left")


SQL_VIEWS["resid_runs"] = """SELECT w.run_id, count(*) FILTER (WHERE y) AS fault_ticks, count(*) FILTER (WHERE y AND a) AS fault_alarms, count(*) FILTER (WHERE NOT y) AS background_ticks, count(*) FILTER (WHERE NOT y AND a) AS background_alarms,
  count(*) FILTER (WHERE a AND argmax_switch = 'S0') AS argmax_correct, count(*) FILTER (WHERE a) AS alarms, count(*) FILTER (WHERE y AND a AND NOT env) AS incremental, max(q.rho) AS rho
  FROM (SELECT w.*, e.y, coalesce(r_max > 0.5, false) AS a, e.alarm AS env FROM worst_r w JOIN evalframe e ON e.run_id = w.run_id AND e.tick = w.tick WHERE e.grp = 'F' AND e.in_eval) w
  LEFT JOIN (SELECT run_id, median(v) / 120.0 AS rho FROM lab WHERE entity = 'link-click' AND tick BETWEEN 2 AND 20 GROUP BY run_id) q ON q.run_id = w.run_id GROUP BY w.run_id"""


def residual_rows(spark, sf):
    from gaugeline.plans.evaluation import frame

    e = frame(spark, sf).where("grp = 'F' and in_eval").select("run_id", "tick", "y", F.col("alarm").alias("env"))
    rows = worst_residual(spark, sf).join(e, ["run_id", "tick"]).withColumn("a", K.alarm(F.col("r_max"), F.lit(0.5)))
    y, a = F.col("y"), F.col("a")
    per = rows.groupBy("run_id").agg(
        F.count_if(y).alias("fault_ticks"), F.count_if(y & a).alias("fault_alarms"), F.count_if(~y).alias("background_ticks"), F.count_if(~y & a).alias("background_alarms"),
        F.count_if(a & (F.col("argmax_switch") == "S0")).alias("argmax_correct"), F.count_if(a).alias("alarms"), F.count_if(y & a & ~F.col("env")).alias("incremental"),
    )
    probe = labelled(spark, sf).where("entity = 'link-click' and tick between 2 and 20")
    rho = Q.quantiles(probe, ["run_id"], "v", {"m": ("middle", 0.5)}).select("run_id", (F.col("m") / 120.0).alias("rho"))
    return per.join(rho, "run_id", "left")


@query("residual_runs", "AG34", f"SELECT * EXCLUDE (rho), {r6('rho')} AS rho FROM resid_runs")
def residual_runs(spark, sf):
    return residual_rows(spark, sf)


@query("residual_verdicts", "AG35", """
WITH d AS (SELECT *, coalesce(fault_alarms / nullif(fault_ticks, 0), 0.0) >= 0.5 AS det, CASE WHEN rho >= 1.1 THEN 'high' WHEN rho <= 0.9 THEN 'low' ELSE 'band' END AS band FROM resid_runs),
c AS (SELECT count(*) FILTER (WHERE band = 'high') AS n_high, count(*) FILTER (WHERE band = 'high' AND det) AS n_high_detected, count(*) FILTER (WHERE band = 'low') AS n_low, count(*) FILTER (WHERE band = 'low' AND det) AS n_low_detected, count(*) FILTER (WHERE band = 'band') AS n_band,
 CAST(sum(background_ticks) AS BIGINT) AS bt, CAST(sum(background_alarms) AS BIGINT) AS ba, CAST(sum(alarms) AS BIGINT) AS al, CAST(sum(argmax_correct) AS BIGINT) AS ac, CAST(sum(incremental) AS BIGINT) AS inc FROM d),
r AS (SELECT *, n_high > 0 AND n_high_detected / n_high < 0.75 AS f1, n_low_detected > 0 AS f2, bt > 0 AND ba / bt > 0.02 AS f3, al > 0 AND ac / al < 0.9 AS f4, inc = 0 AS f5 FROM c)
SELECT n_high, n_high_detected, n_low, n_low_detected, n_band, f1, f2, f3, f4, f5, CASE WHEN f1 OR f2 OR f3 OR f5 THEN 'any_refuted' WHEN f4 THEN 'f4_only' ELSE 'all_pass' END AS outcome FROM r""")
def residual_verdicts(spark, sf):
    det = F.coalesce(F.try_divide(F.col("fault_alarms").cast("double"), F.col("fault_ticks")), F.lit(0.0)) >= 0.5
    band = F.when(F.col("rho") >= 1.1, "high").when(F.col("rho") <= 0.9, "low").otherwise("band")
    d = residual_rows(spark, sf).withColumns({"det": det, "band": band})
    c = d.agg(
        *[F.count_if(F.col("band") == b).alias(f"n_{b}") for b in ("high", "low", "band")],
        *[F.count_if((F.col("band") == b) & F.col("det")).alias(f"n_{b}_detected") for b in ("high", "low")],
        *[F.sum(x).alias(f"_{x}") for x in ("background_ticks", "background_alarms", "alarms", "argmax_correct", "incremental")],
    )
    share = lambda x, y: F.try_divide(F.col(x).cast("double"), F.col(y).cast("double"))
    flags = {
        "f1": F.coalesce(share("n_high_detected", "n_high") < 0.75, F.lit(False)), "f2": F.col("n_low_detected") > 0,
        "f3": F.coalesce(share("_background_alarms", "_background_ticks") > 0.02, F.lit(False)),
        "f4": F.coalesce(share("_argmax_correct", "_alarms") < 0.9, F.lit(False)), "f5": F.col("_incremental") == 0,
    }
    c = c.withColumns(flags)
    outcome = F.when(F.col("f1") | F.col("f2") | F.col("f3") | F.col("f5"), "any_refuted").when(F.col("f4"), "f4_only").otherwise("all_pass")
    return c.select("n_high", "n_high_detected", "n_low", "n_low_detected", "n_band", *flags, outcome.alias("outcome"))


@query("load_floor_threshold", "AG40", f"""
WITH t AS (SELECT run_id, tick, CASE WHEN count(v) = (SELECT count(DISTINCT entity) FROM ev) THEN min(v) END AS g FROM lab WHERE split = 'train' GROUP BY run_id, tick)
SELECT run_id, {r6('max(g)')} AS g_max, arg_min(tick, (-g, tick)) AS owner_tick, count(*) AS n_rows, count(*) FILTER (WHERE g IS NULL) AS n_unjudgeable FROM t GROUP BY run_id""")
def load_floor_threshold(spark, sf):
    ticks = labelled(spark, sf).where("split = 'train'").groupBy("run_id", "tick").agg(F.when(F.count("v") == V.n_entities(spark, sf), F.min("v")).alias("g"))
    best = F.min(F.when(F.col("g").isNotNull(), F.struct((-F.col("g")).alias("n"), F.col("tick"))))
    out = ticks.groupBy("run_id").agg(best.alias("b"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("g").isNull()).alias("n_unjudgeable"))
    return out.select("run_id", (-F.col("b.n")).alias("g_max"), F.col("b.tick").alias("owner_tick"), "n_rows", "n_unjudgeable")
