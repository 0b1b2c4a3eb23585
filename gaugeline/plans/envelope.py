"""Envelope fit, scores, decisions, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import envelope as O
from gaugeline.plans import views as V
from gaugeline.plans.registry import query, r6
from gaugeline.plans.views import SQL_VIEWS
from gaugeline.session import cut_lineage

FAMILIES = {"indicator": list(V.INDICATORS), "rate": [e for e in V.ENTITIES if e not in V.INDICATORS]}


def train_cells(spark, sf):
    return V.valid_rates(spark, sf).where("tick >= 1").join(
        V.runs(spark, sf).where("split = 'train'").select("run_id", "profile"), "run_id"
    )


def bounds(spark, sf):
    """The fitted model is an artifact: it is stored, and its readers know its size."""
    return cut_lineage(O.fit_bounds(train_cells(spark, sf), "entity", "rate"))


def scores(spark, sf):
    return O.score(V.valid_rates(spark, sf), bounds(spark, sf), ["run_id", "tick"], "entity", "rate", V.n_entities(spark, sf), FAMILIES)


@query("run_alarm_summary", "AG5 AG6 AG7 SRC1 PRJ8", f"""
SELECT run_id, any_value(split) AS split, count(*) AS n_ticks, count(*) FILTER (WHERE judgeable) AS n_judgeable,
  count(*) FILTER (WHERE judgeable AND k > 0) AS n_alarm, max(k) AS k_max, {r6('max(excess)')} AS excess_max
FROM scores JOIN runs USING (run_id) GROUP BY run_id""")
def run_alarm_summary(spark, sf):
    return scores(spark, sf).join(V.runs(spark, sf).select("run_id", "split"), "run_id").groupBy("run_id", "split").agg(
        F.count(F.lit(1)).alias("n_ticks"), F.count_if("judgeable").alias("n_judgeable"),
        F.count_if(F.col("judgeable") & (F.col("k") > 0)).alias("n_alarm"), F.max("k").alias("k_max"),
        F.max("excess").alias("excess_max"),
    )


@query("envelope_bounds", "AG4", f"SELECT entity, {r6('lo')} AS lo, {r6('hi')} AS hi FROM bounds")
def envelope_bounds(spark, sf):
    return bounds(spark, sf)


@query("envelope_scores", "AG5", f"SELECT run_id, tick, k, k_indicator, k_rate, {r6('excess')} AS excess, judgeable FROM scores")
def envelope_scores(spark, sf):
    return scores(spark, sf)


@query("envelope_decisions", "AG6", f"""
WITH t AS (SELECT max(excess) AS e, max(k_indicator) AS k1, max(k_rate) AS k2 FROM scores JOIN runs USING (run_id)
  WHERE split = 'train' AND judgeable AND tick >= 1)
SELECT run_id, tick, judgeable AND excess > e AS suspect, judgeable AND (k_indicator > k1 OR k_rate > k2) AS act,
  judgeable AND k_indicator > k1 AND k_rate > k2 AS both FROM scores, t""")
def envelope_decisions(spark, sf):
    s = scores(spark, sf)
    train = V.runs(spark, sf).where("split = 'train'").select("run_id")
    limits = s.where("judgeable and tick >= 1").join(train, "run_id", "left_semi").agg(
        F.max("excess").alias("e"), F.max("k_indicator").alias("k1"), F.max("k_rate").alias("k2")
    )
    decided = O.decide(s.crossJoin(F.broadcast(limits)), F.col("e"), F.col("k1"), F.col("k2"))
    both = F.col("judgeable") & (F.col("k_indicator") > F.col("k1")) & (F.col("k_rate") > F.col("k2"))
    return decided.select("run_id", "tick", "suspect", "act", both.alias("both"))


@query("train_threshold", "AG7", f"""
SELECT max(k) AS k_train_max, {r6('avg(k)')} AS k_train_mean, count(*) AS n_rows, count(*) FILTER (WHERE NOT judgeable) AS n_missing
FROM scores JOIN runs USING (run_id) WHERE split = 'train' AND tick >= 1""")
def train_threshold(spark, sf):
    train = V.runs(spark, sf).where("split = 'train'").select("run_id")
    return scores(spark, sf).where("tick >= 1").join(train, "run_id", "left_semi").agg(
        F.max("k").alias("k_train_max"), F.avg("k").alias("k_train_mean"), F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("judgeable")).alias("n_missing"),
    )


HELDOUT = """
WITH c AS (SELECT profile, run_id, tick, entity, CASE WHEN ok THEN rate END AS rate FROM cells JOIN runs USING (run_id) WHERE split = 'train' AND tick >= 1),
b AS (SELECT f.profile, c.entity, min(c.rate) AS flo, max(c.rate) AS fhi FROM (SELECT DISTINCT profile FROM c) f JOIN c ON c.profile <> f.profile GROUP BY ALL),
h AS (SELECT c.profile, run_id, tick, count(*) FILTER (WHERE rate < flo OR rate > fhi) AS k,
  sum(coalesce(greatest(flo - rate, rate - fhi, 0.0) / greatest(fhi - flo, 1.0), 0.0)) AS excess, count(rate) = (SELECT count(DISTINCT entity) FROM ev) AS judgeable
  FROM c JOIN b ON b.profile = c.profile AND b.entity = c.entity GROUP BY c.profile, run_id, tick)
"""


@query("heldout_calibration", "AG8", HELDOUT + f"""
SELECT profile, max(k) AS k_limit, {r6('max(excess)')} AS e_limit, count(*) AS n_rows, count(*) FILTER (WHERE k > 0) AS n_outside
FROM h WHERE judgeable GROUP BY profile""")
def heldout_calibration(spark, sf):
    held = O.heldout_scores(train_cells(spark, sf), ["run_id", "tick"], "profile", "entity", "rate", V.n_entities(spark, sf))
    return held.where("judgeable").groupBy("profile").agg(
        F.max("k").alias("k_limit"), F.max("excess").alias("e_limit"), F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("k") > 0).alias("n_outside"),
    )


@query("threshold_owners", "AG9", HELDOUT + f"""
SELECT profile, {r6('excess')} AS excess, run_id, tick FROM h WHERE judgeable
QUALIFY row_number() OVER (PARTITION BY profile ORDER BY excess DESC, run_id, tick) = 1""")
def threshold_owners(spark, sf):
    held = O.heldout_scores(train_cells(spark, sf), ["run_id", "tick"], "profile", "entity", "rate", V.n_entities(spark, sf))
    return O.owner_of_max(held.where("judgeable"), ["profile"], "excess", ["run_id", "tick"])


@query("feature_selection", "AG3", f"""
WITH a AS (SELECT entity, 100.0 * avg(CASE WHEN ok THEN 0 ELSE 1 END) AS pct_null, count(DISTINCT CASE WHEN ok THEN rate END) AS n_distinct,
  min(CASE WHEN ok THEN rate END) AS lo, max(CASE WHEN ok THEN rate END) AS hi, count(*) FILTER (WHERE ok) AS n_valid
  FROM cells JOIN runs USING (run_id) WHERE split = 'train' AND tick >= 1 GROUP BY entity)
SELECT entity, {r6('pct_null')} AS pct_null, n_distinct, {r6('lo')} AS lo, {r6('hi')} AS hi, n_valid,
  CASE WHEN n_valid = 0 OR pct_null > 20 THEN 'dropped' WHEN n_distinct > 1 THEN 'feature'
  WHEN entity IN ('link-error', 'link-signup') THEN 'envelope_only' ELSE 'dead' END AS outcome FROM a""")
def feature_selection(spark, sf):
    audit = O.column_audit(train_cells(spark, sf), "entity", "rate")
    outcome = (
        F.when((F.col("n_valid") == 0) | (F.col("pct_null") > 20), "dropped")
        .when(F.col("n_distinct") > 1, "feature")
        .when(F.col("entity").isin(list(V.INDICATORS)), "envelope_only")
        .otherwise("dead")
    )
    return audit.select("entity", "pct_null", "n_distinct", "lo", "hi", "n_valid", outcome.alias("outcome"))


# The fitted model, and one that drifted: a column twice, one without bounds, bounds turned round and
# of a strange column, an empty family, a family without threshold, an overlap and a gap of the parts.
SQL_VIEWS["m_columns"] = "SELECT m, entity AS c FROM bounds, (VALUES ('fitted'), ('drifted')) v(m) UNION ALL SELECT 'drifted', 'link-click'"
SQL_VIEWS["m_families"] = """SELECT m, f, entity AS c FROM bounds, (VALUES ('fitted'), ('drifted')) v(m), (VALUES ('primary'), ('indicator'), ('rate_shared'), ('loss_only')) w(f)
  WHERE (f IN ('primary', 'loss_only') OR (f = 'indicator') = (entity IN ('link-error', 'link-signup'))) AND NOT (m = 'drifted' AND (f = 'loss_only' OR (f = 'rate_shared' AND entity = 'link-view')))
  UNION ALL SELECT 'drifted', 'rate_shared', 'link-error' UNION ALL SELECT 'drifted', 'indicator', 'link-ghost'"""
SQL_VIEWS["m_bounds"] = """SELECT m, entity AS c, CASE WHEN m = 'drifted' AND entity = 'link-error' THEN hi ELSE lo END AS lo, CASE WHEN m = 'drifted' AND entity = 'link-error' THEN lo ELSE hi END AS hi
  FROM bounds, (VALUES ('fitted'), ('drifted')) v(m) WHERE NOT (m = 'drifted' AND entity = 'link-purchase') UNION ALL SELECT 'drifted', 'link-odd', 0, 1"""


@query("model_contract", "PRJ24", """
WITH th AS (SELECT DISTINCT m, f FROM m_families WHERE NOT (m = 'drifted' AND f = 'primary')), cc AS (SELECT DISTINCT m, c FROM m_columns),
part AS (SELECT m, c, count(DISTINCT f) AS n FROM m_families WHERE f IN ('indicator', 'rate_shared') GROUP BY m, c)
SELECT m AS model, 'duplicate column' AS rule, c AS name FROM m_columns GROUP BY m, c HAVING count(*) > 1 UNION ALL SELECT m, 'no bounds', c FROM cc ANTI JOIN m_bounds USING (m, c)
UNION ALL SELECT m, 'bounds of no column', c FROM m_bounds ANTI JOIN cc USING (m, c) UNION ALL SELECT m, 'bad bounds', c FROM m_bounds WHERE lo > hi
UNION ALL SELECT m, 'no family', f FROM (VALUES ('fitted'), ('drifted')) v(m), (VALUES ('primary'), ('indicator'), ('rate_shared'), ('loss_only')) w(f) WHERE (m, f) NOT IN (SELECT m, f FROM m_families)
UNION ALL SELECT m, 'no threshold', f FROM (SELECT DISTINCT m, f FROM m_families) x ANTI JOIN th USING (m, f) UNION ALL SELECT m, 'unknown column', f || ':' || c FROM m_families ANTI JOIN cc USING (m, c)
UNION ALL SELECT m, 'not in primary', c FROM cc ANTI JOIN (SELECT * FROM m_families WHERE f = 'primary') p USING (m, c)
UNION ALL SELECT m, 'in both parts', c FROM part WHERE n = 2 UNION ALL SELECT m, 'in no part', c FROM cc ANTI JOIN part USING (m, c)""")
def model_contract(spark, sf):
    fitted = bounds(spark, sf)
    both = fitted.select(F.explode(F.array(F.lit("fitted"), F.lit("drifted"))).alias("model"), F.col("entity").alias("column"), "lo", "hi")
    drifted = F.col("model") == "drifted"
    row = lambda *values: spark.createDataFrame([values], "model string, family string, column string")
    columns = both.select("model", "column").unionByName(row("drifted", "", "link-click").drop("family"))
    member = F.col("family").isin("primary", "loss_only") | ((F.col("family") == "indicator") == F.col("column").isin(*V.INDICATORS))
    lost = drifted & ((F.col("family") == "loss_only") | ((F.col("family") == "rate_shared") & (F.col("column") == "link-view")))
    families = both.select("model", "column", F.explode(F.array(*map(F.lit, O.REQUIRED_FAMILIES))).alias("family")).where(member & ~lost)
    families = families.unionByName(row("drifted", "rate_shared", "link-error")).unionByName(row("drifted", "indicator", "link-ghost"))
    turned = drifted & (F.col("column") == "link-error")
    limits = both.where(~(drifted & (F.col("column") == "link-purchase"))).select(
        "model", "column", F.when(turned, F.col("hi")).otherwise(F.col("lo")).alias("lo"), F.when(turned, F.col("lo")).otherwise(F.col("hi")).alias("hi"))
    limits = limits.unionByName(row("drifted", "", "link-odd").select("model", "column", F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")))
    thresholds = families.select("model", "family").distinct().where(~(drifted & (F.col("family") == "primary"))).withColumn("threshold", F.lit(1.0))
    return O.contract_violations(columns, families, limits, thresholds, ["model"])
