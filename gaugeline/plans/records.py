"""Joins over intervention, audit and twin records, and row-level views."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import names as FN
from gaugeline.functions import stats
from gaugeline.functions.health import host_health, path_health
from gaugeline.operators import bitmaps as B
from gaugeline.operators import intervals as I
from gaugeline.operators import matching as M
from gaugeline.operators import patches as PT
from gaugeline.operators import scan as S
from gaugeline.plans import network as N
from gaugeline.plans import views as V
from gaugeline.plans.registry import query, r6
from gaugeline.plans.views import SQL_VIEWS
from gaugeline.session import cut_lineage
from gaugeline.sources import logs as L
from gaugeline.sources import sinks as K

DAY = 86400 * 10**6


@query("active_interventions", "JN4", """
WITH x AS (SELECT actor, id, t_start, coalesce(t_revert + 8, t_start + 120) AS e FROM orders_x)
SELECT p.actor, p.id, p.t_start AS at, arg_min(x.id, (x.t_start, x.id)) AS owner, min(x.t_start) AS since FROM orders_x p LEFT JOIN x ON x.actor = p.actor AND x.t_start <= p.t_start AND p.t_start < x.e GROUP BY ALL""")
def active_interventions(spark, sf):
    x = V.interventions(spark, sf)
    end = I.lease_end(F.col("t_start"), F.col("t_revert"), 8.0, 120.0)
    spans = x.select("actor", F.col("id").alias("other"), F.col("t_start").alias("s"), end.cast("double").alias("e"))
    held = I.owners(x.select("actor", "id", F.col("t_start").alias("at")), spans, ["actor"], "at", "s", "e", ["other"])
    return held.select("actor", "id", "at", F.col("owner.other").alias("owner"), F.col("owner.s").cast("bigint").alias("since"))


@query("active_counts", "JN4 ST4", """
WITH x AS (SELECT actor, t_start, coalesce(t_revert + 8, t_start + 120) AS e FROM orders_x)
SELECT p.actor, p.id, count(x.t_start) AS n_active FROM orders_x p LEFT JOIN x ON x.actor = p.actor AND x.e > x.t_start AND x.t_start <= p.t_start AND p.t_start < x.e GROUP BY ALL""")
def active_counts(spark, sf):
    x = V.interventions(spark, sf)
    end = I.lease_end(F.col("t_start"), F.col("t_revert"), 8.0, 120.0).cast("double")
    spans = x.select("actor", F.col("t_start").alias("s"), end.alias("e")).where("e > s")
    return I.active_counts(x.select("actor", "id", "t_start"), spans, ["actor"], "t_start", "s", "e").select("actor", "id", "n_active")


@query("stale_leases", "JN5", "SELECT actor, id FROM orders_x WHERE t_revert IS NULL AND (SELECT max(t_start) FROM orders_x) >= t_start + 120")
def stale_leases(spark, sf):
    x = V.interventions(spark, sf)
    now = F.broadcast(x.agg(F.max("t_start").alias("now")))
    closes = x.where("t_revert is not null").select("id")
    return M.expired_leases(x.join(now), closes, ["id"], "t_start", F.col("now"), 120.0).select("actor", "id")


@query("intervention_pairs", "JN6", """
WITH i AS (SELECT event_id, user_id || ':' || k AS pk, tick, us FROM series WHERE event_type IN ('click', 'view')), r AS (SELECT user_id || ':' || k AS pk, max(us) AS t_revert FROM series WHERE event_type = 'purchase' GROUP BY 1)
SELECT i.pk AS pair_key, max(i.us) AS t_inject, any_value(t_revert) AS t_revert, any_value(t_revert) - max(i.us) AS hold FROM i LEFT JOIN r ON r.pk = i.pk GROUP BY i.pk""")
def intervention_pairs(spark, sf):
    kind = F.when(F.col("event_type").isin("click", "view"), "inject").when(F.col("event_type") == "purchase", "revert")
    rows = V.ev(spark, sf).withColumn("id", F.concat_ws(":", "user_id", "k", kind)).where(kind.isNotNull())
    keyed = rows.select(F.regexp_replace("id", ":[^:]*$", "").alias("pair_key"), F.regexp_extract("id", "[^:]*$", 0).alias("kind"), "us")
    out = keyed.groupBy("pair_key").agg(F.max(F.when(F.col("kind") == "inject", F.col("us"))).alias("t_inject"), F.max(F.when(F.col("kind") == "revert", F.col("us"))).alias("t_revert"))
    return out.where("t_inject is not null").withColumn("hold", F.col("t_revert") - F.col("t_inject"))


@query("intent_results", "JN7", """
WITH i AS (SELECT o_orderkey AS cid, epoch_us(o_orderdate) // 86400000000 AS t FROM orders WHERE o_orderpriority <> '5-LOW' AND epoch_us(o_orderdate) // 86400000000 BETWEEN 9300 AND 11000),
r AS (SELECT l_orderkey AS cid, max(epoch_us(l_shipdate) // 86400000000) AS t_done, arg_max(l_returnflag, (epoch_us(l_shipdate), l_returnflag)) AS outcome FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT cid, t, t_done, outcome FROM i LEFT JOIN r USING (cid)""")
def intent_results(spark, sf):
    o, l = V.table(spark, sf, "orders"), V.table(spark, sf, "lineitem")
    day = lambda df, c: F.floor(V.micros(df, c) / DAY).cast("bigint")
    intents = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("cid"), day(o, "o_orderdate").alias("t")).where("t between 9300 and 11000")
    results = l.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("cid"), day(l, "l_shipdate").alias("t_done"), F.col("l_returnflag").alias("outcome"))
    return M.pair_intents(intents, results, "cid", ["t_done"], ["outcome"])


@query("orphan_intents", "JN8", "SELECT o_custkey AS actor, count(*) AS n_orphans FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') GROUP BY 1")
def orphan_intents(spark, sf):
    intents = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("cid"), F.col("o_custkey").alias("actor"))
    results = V.table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("cid"))
    return M.orphans(intents, results, "cid").groupBy("actor").agg(F.count(F.lit(1)).alias("n_orphans"))


@query("twin_completeness", "JN9 SET2", """
WITH e AS (SELECT DISTINCT l_partkey AS id, 'part' AS kind FROM lineitem WHERE l_returnflag = 'R' UNION SELECT DISTINCT l_suppkey, 'supplier' FROM lineitem WHERE l_quantity > 49),
a AS (SELECT p_partkey AS id, 'part' AS kind FROM part WHERE p_size > 5 UNION SELECT s_suppkey, 'supplier' FROM supplier WHERE s_acctbal > 0)
SELECT coalesce(e.kind, a.kind) AS kind, count(e.id) AS expected, count(a.id) AS actual, count(*) FILTER (WHERE a.id IS NULL) AS missing, count(*) FILTER (WHERE e.id IS NULL) AS extra FROM e FULL JOIN a ON a.id = e.id AND a.kind = e.kind GROUP BY 1""")
def twin_completeness(spark, sf):
    items = V.table(spark, sf, "lineitem")
    expected = items.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"), F.lit("part").alias("kind")).unionByName(
        items.where("l_quantity > 49").select(F.col("l_suppkey").alias("id"), F.lit("supplier").alias("kind"))).distinct()
    actual = V.table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind")).unionByName(
        V.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")))
    return M.completeness(expected, actual, ["id"], ["kind"])


@query("twin_accuracy", "JN10 FN7", f"""
WITH g AS (SELECT l_suppkey AS id, round(avg(l_discount) * 1000, 3) AS gt FROM lineitem GROUP BY 1), t AS (SELECT l_suppkey AS id, round(avg(l_discount) * 1000, 3) AS tw FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
SELECT count(*) AS checked, count(*) FILTER (WHERE abs(gt - tw) < 1.0 OR (gt <> 0 AND abs(gt - tw) / abs(gt) < 0.05)) AS matched, {r6('100.0 * count(*) FILTER (WHERE abs(gt - tw) < 1.0 OR (gt <> 0 AND abs(gt - tw) / abs(gt) < 0.05)) / count(*)')} AS accuracy FROM g LEFT JOIN t USING (id)""")
def twin_accuracy(spark, sf):
    items = V.table(spark, sf, "lineitem")
    mean = F.round(F.avg("l_discount") * 1000, 3)
    gt = items.groupBy(F.col("l_suppkey").alias("id")).agg(mean.alias("gt"))
    tw = items.where("l_returnflag <> 'A'").groupBy(F.col("l_suppkey").alias("id")).agg(mean.alias("tw"))
    ok = stats.tolerant_equal(F.col("gt"), F.col("tw"))
    return gt.join(tw, "id", "left").agg(F.count(F.lit(1)).alias("checked"), F.count_if(ok).alias("matched"), (100.0 * F.count_if(ok) / F.count(F.lit(1))).alias("accuracy"))


@query("source_time_lookup", "JN11", """
WITH t AS (SELECT user_id, k AS seq, max(us) AS t_source FROM ev WHERE event_type = 'view' GROUP BY 1, 2) SELECT e.event_id, t.t_source FROM ev e LEFT JOIN t ON t.user_id = e.user_id AND t.seq = e.k WHERE e.event_type = 'click'""")
def source_time_lookup(spark, sf):
    rows = V.ev(spark, sf)
    index = M.last_per_key(rows.where("event_type = 'view'"), ["user_id", "k"], ["us"], ["event_id"]).select("user_id", "k", F.col("us").alias("t_source"))
    return rows.where("event_type = 'click'").join(index, ["user_id", "k"], "left").select("event_id", "t_source")


@query("act_attribution", "JN12 GR4", """
WITH a AS (SELECT run_id, tick, min(us) AS us FROM ev WHERE value > 100 GROUP BY ALL),
o AS (SELECT a.run_id, a.tick, arg_min(x.iid, (x.us, x.iid)) AS owner, arg_min(coalesce(x.target, ''), (x.us, x.iid)) AS target FROM a JOIN acts_z x ON x.run_id = a.run_id AND x.us <= a.us AND a.us < x.us + 86400000000 GROUP BY ALL),
nb AS (SELECT a.run_id, a.tick, min(abs(a.us - x.us)) AS d FROM a JOIN acts_z x USING (run_id) GROUP BY ALL),
c AS (SELECT v.run_id, v.tick, count(*) AS n, count(z.entity) AS i FROM viol_z v JOIN a USING (run_id, tick) LEFT JOIN o USING (run_id, tick) LEFT JOIN zone_z z ON z.target = o.target AND z.entity = v.entity GROUP BY ALL)
SELECT a.run_id, a.tick, CASE WHEN owner IS NULL THEN 'unattributed' WHEN c.n = c.i THEN 'type_i' ELSE 'type_ii' END AS class, owner, c.n AS n_affected, CASE WHEN owner IS NOT NULL THEN c.i END AS n_inside,
  CASE WHEN owner IS NULL THEN nb.d END AS nearest_us FROM a JOIN c USING (run_id, tick) LEFT JOIN o USING (run_id, tick) LEFT JOIN nb USING (run_id, tick)""")
def act_attribution(spark, sf):
    """Act ticks of a run: the first intervention whose window holds them, and whether all affected switches
    lie in its zone."""
    acts = V.ev(spark, sf).where("value > 100").groupBy("run_id", "tick").agg(F.min("us").alias("us"))
    done = cut_lineage(N.link_acts(spark, sf))
    spans = done.select("run_id", "iid", "target", F.col("us").alias("s"), (F.col("us") + DAY).alias("e"))
    held = I.owners(acts, spans, ["run_id"], "us", "s", "e", ["iid", "target"])
    starts = spans.select("run_id", F.col("s").alias("us"), F.col("s").alias("t"))
    before = M.as_of(held, starts, ["run_id"], "us", ["t"]).withColumnRenamed("_hit", "_b")
    near = cut_lineage(M.as_of(before, starts, ["run_id"], "us", ["t"], forward=True))
    gap = F.least(F.col("us") - F.col("_b.at"), F.col("_hit.at") - F.col("us"))
    zones, numbers = N.switch_zones(spark, sf)
    tick = ["run_id", "tick"]
    sets = B.bitmaps(N.violating_switches(spark, sf).join(near.select(*tick), tick, "left_semi").join(numbers, "entity"), tick)
    own = near.where("owner is not null").select(*tick, F.col("owner.target").alias("target")).join(zones, "target").drop("target")
    told = near.join(B.contained(sets, own, tick), tick)
    owner = F.col("owner.iid")
    kind = F.when(owner.isNull(), "unattributed").when(F.col("n_inside") == F.col("n_members"), "type_i").otherwise("type_ii")
    return told.select(
        *tick, kind.alias("class"), owner.alias("owner"), F.col("n_members").alias("n_affected"), F.when(owner.isNotNull(), F.col("n_inside")).alias("n_inside"), F.when(owner.isNull(), gap).alias("nearest_us"))


@query("capacity_reconcile", "JN18", f"""
WITH w AS (SELECT o_custkey AS id, avg(o_totalprice) AS want FROM orders GROUP BY 1), h AS (SELECT o_custkey AS id, avg(o_totalprice) AS have FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT id, {r6('want')} AS want, {r6('have')} AS have, CASE WHEN have IS NULL THEN 'unknown' WHEN abs(have - want) > 5000 THEN 'drift' ELSE 'ok' END AS verdict FROM w LEFT JOIN h USING (id)""")
def capacity_reconcile(spark, sf):
    o = V.table(spark, sf, "orders")
    mean = F.avg("o_totalprice")
    want = o.groupBy(F.col("o_custkey").alias("id")).agg(mean.alias("want"))
    have = o.where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("id")).agg(mean.alias("have"))
    verdict = F.when(F.col("have").isNull(), "unknown").when(F.abs(F.col("have") - F.col("want")) > 5000, "drift").otherwise("ok")
    return want.join(have, "id", "left").withColumn("verdict", verdict)


@query("result_diff", "JN22", """
WITH a AS (SELECT run_id, entity, max(rate) AS v FROM cells WHERE tick < 40 GROUP BY ALL), b AS (SELECT run_id, entity, max(rate) AS v FROM cells WHERE tick >= 10 AND entity <> 'link-view' GROUP BY ALL)
SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN b.v IS NULL THEN 'only_left' WHEN a.v IS NULL THEN 'only_right' WHEN abs(a.v - b.v) < 1e-6 THEN 'same' ELSE 'differs' END AS verdict FROM a FULL JOIN b ON a.run_id = b.run_id AND a.entity = b.entity) GROUP BY 1""")
def result_diff(spark, sf):
    c = V.cells(spark, sf)
    top = lambda df: df.groupBy("run_id", "entity").agg(F.max("rate").alias("v"))
    out = M.compare_tables(top(c.where("tick < 40")), top(c.where("tick >= 10 and entity <> 'link-view'")), ["run_id", "entity"], "v", 1e-6)
    return out.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("node_edge_tables", "PRJ14 FN12", """
SELECT 'node' AS kind, count(*) AS n, count(DISTINCT nm) AS n_names FROM (SELECT 'h' || s_suppkey AS nm FROM supplier UNION ALL SELECT 's' || n_nationkey FROM nation)
UNION ALL SELECT 'edge', count(*), count(DISTINCT s_suppkey || '-' || s_nationkey) FROM supplier WHERE s_acctbal >= 0""")
def node_edge_tables(spark, sf):
    s, n = V.table(spark, sf, "supplier"), V.table(spark, sf, "nation")
    host = F.concat(F.lit("org:host-h"), F.col("s_suppkey").cast("string"))
    links = s.select(
        F.concat(F.lit("org:link-"), F.col("s_suppkey").cast("string"), F.lit("-"), F.col("s_nationkey").cast("string")).alias("id"), F.lit("link").alias("type"),
        host.alias("a"), F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey").cast("string")).alias("b"),
    )
    nodes = s.select(host.alias("id"), F.lit("host").alias("type")).unionByName(n.select(F.concat(F.lit("org:switch-s"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("switch").alias("type")))
    things = nodes.unionByName(links, allowMissingColumns=True)
    kind = F.when(F.col("type").isin("host", "switch", "controller"), "node").when(F.col("a").isNotNull() & F.col("b").isNotNull(), "edge")
    name = F.regexp_replace(FN.short_name(F.col("id")), "^(host|switch|link)-", "")
    return things.select(kind.alias("kind"), name.alias("nm")).where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("nm").alias("n_names"))


# Row-level detector views: every event read as one published message.
STATE = {"click": "act", "view": "normal", "error": "unknown", "signup": "warming_up", "purchase": "suspect"}
SQL_VIEWS["dview"] = """SELECT event_id, k, value, CASE event_type WHEN 'click' THEN 'act' WHEN 'view' THEN 'normal' WHEN 'error' THEN 'unknown' WHEN 'signup' THEN 'warming_up' ELSE 'suspect' END AS state,
  CASE k % 5 WHEN 1 THEN 'stale_intervention' WHEN 2 THEN 'out_of_operating_range' WHEN 3 THEN 'suppressed_intervention' ELSE '' END AS cause, k % 6 <> 0 AS fresh FROM ev"""


def detector_views(spark, sf):
    kinds = F.create_map(*[F.lit(x) for pair in STATE.items() for x in pair])
    m = F.col("k") % 5
    cause = F.when(m == 1, "stale_intervention").when(m == 2, "out_of_operating_range").when(m == 3, "suppressed_intervention").otherwise("")
    return V.ev(spark, sf).select("event_id", "k", "value", kinds[F.col("event_type")].alias("state"), cause.alias("cause"), (F.col("k") % 6 != 0).alias("fresh"))


@query("view_labels", "PRJ16", """
SELECT event_id, CASE WHEN NOT fresh THEN 'stale' WHEN cause = 'stale_intervention' THEN cause WHEN cause = 'out_of_operating_range' THEN 'out_of_range' WHEN state = 'warming_up' THEN 'warming' WHEN state = 'unknown' AND cause = 'suppressed_intervention' THEN 'suppressed'
 WHEN state = 'unknown' THEN 'unknown' WHEN state = 'act' THEN 'act' ELSE 'quiet' END AS label FROM dview""")
def view_labels(spark, sf):
    from gaugeline.functions.states import view_label

    return detector_views(spark, sf).select("event_id", view_label(F.col("fresh"), F.col("state"), F.col("cause")).alias("label"))


@query("timeline_categories", "PRJ17", """
SELECT event_id, CASE WHEN state = 'unknown' AND cause = 'suppressed_intervention' THEN 'suppressed' WHEN state IN ('suspect', 'act') THEN CASE WHEN value > 60 THEN 'env_alarm' WHEN k % 4 = 0 THEN 'residual_only' ELSE 'held' END ELSE state END AS category FROM dview""")
def timeline_categories(spark, sf):
    from gaugeline.functions.states import timeline_category

    return detector_views(spark, sf).select("event_id", timeline_category(F.col("state"), F.col("state"), F.col("cause"), F.col("value") > 60, F.lit(False), F.col("k") % 4 == 0).alias("category"))


@query("alarm_views", "PRJ26", """
SELECT event_id, CASE WHEN NOT fresh THEN 'stale' WHEN state = 'act' THEN 'critical' WHEN state = 'suspect' THEN 'warning' WHEN state = 'normal' THEN 'ok' ELSE 'unknown' END AS severity,
 CASE WHEN state NOT IN ('suspect', 'act') THEN '' WHEN value > 60 AND k % 4 = 0 THEN 'fast+slow' WHEN value > 60 THEN 'fast' WHEN k % 4 = 0 THEN 'slow' ELSE 'held' END AS channel FROM dview""")
def alarm_views(spark, sf):
    from gaugeline.functions.states import alarm_channel, severity

    d = detector_views(spark, sf)
    return d.select("event_id", severity(F.col("state"), ~F.col("fresh")).alias("severity"), alarm_channel(F.col("state"), F.col("value") > 60, F.col("k") % 4 == 0).alias("channel"))


@query("affected_split", "PRJ26", """
SELECT o_custkey AS alarm, count(*) FILTER (WHERE s_acctbal >= 0) AS n_highlight, count(*) FILTER (WHERE s_acctbal IS NULL OR s_acctbal < 0) AS n_unmatched FROM (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT') LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def affected_split(spark, sf):
    o = V.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    hit = o.join(V.table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("alarm"), F.col("l_suppkey").alias("id")).distinct()
    known = V.table(spark, sf, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("id"), F.lit(True).alias("k"))
    return hit.join(known, "id", "left").groupBy("alarm").agg(F.count("k").alias("n_highlight"), F.count_if(F.col("k").isNull()).alias("n_unmatched"))


@query("config_keys", "PRJ20", "SELECT run_id, profile || '|' || CASE WHEN n_events % 4 = 0 THEN 'vary' ELSE CAST(n_events % 4 AS VARCHAR) END AS config, substr(run_id, 1, 1) AS prefix FROM runs")
def config_keys(spark, sf):
    load = F.when(F.col("n_events") % 4 != 0, (F.col("n_events") % 4).cast("string"))
    return V.runs(spark, sf).select("run_id", F.concat_ws("|", "profile", F.coalesce(load, F.lit("vary"))).alias("config"), F.substring("run_id", 1, 1).alias("prefix"))


@query("pool_counts", "AG58 PRJ25", """
SELECT l_orderkey AS pool, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'N') AS pending, count(*) FILTER (WHERE l_returnflag = 'A') AS in_service, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'O') AS healthy,
 count(*) FILTER (WHERE l_returnflag = 'R') AS terminating, sum(l_quantity) > 30 AS poll_ok, CASE WHEN sum(l_quantity) > 30 THEN max(epoch_us(l_shipdate)) END AS t_source FROM lineitem GROUP BY l_orderkey""")
def pool_counts(spark, sf):
    from gaugeline.operators.pools import pool_counts as counts

    items = V.table(spark, sf, "lineitem")
    rows = items.select(
        F.col("l_orderkey").alias("pool"), V.micros(items, "l_shipdate").alias("us"), "l_quantity",
        F.when(F.col("l_returnflag") == "N", "Pending:Wait").when(F.col("l_returnflag") == "A", "InService").otherwise("Terminating:Wait").alias("lifecycle"),
        F.when(F.col("l_linestatus") == "O", "healthy").otherwise("unhealthy").alias("health"),
    )
    ok = F.sum("l_quantity") > 30
    return counts(rows, ["pool"], extra=[ok.alias("poll_ok"), F.when(ok, F.max("us")).alias("t_source")])


@query("merged_documents", "FN8", """
SELECT user_id, path, value, us FROM twin_writes w WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM twin_writes l WHERE l.user_id = w.user_id AND (l.us, l.event_id) > (w.us, w.event_id)
  AND (l.path = w.path OR starts_with(w.path, l.path || '/') OR starts_with(l.path, w.path || '/')))""")
def merged_documents(spark, sf):
    keys, order = ["user_id"], ["us", "event_id"]
    log = PT.leaves(V.twin_patches(spark, sf), keys, order, "patch")
    return PT.document(log, keys, order).select("user_id", F.array_join("path", "/").alias("path"), "value", "us")


@query("latest_twin_state", "SRC11", f"SELECT user_id, event_type AS path, {r6('arg_max(value, (us, event_id))')} AS value, max(us) AS us FROM ev GROUP BY 1, 2")
def latest_twin_state(spark, sf):
    return K.latest_state(V.ev(spark, sf), ["user_id", "event_type"], ["us", "event_id"], ["value"]).select("user_id", F.col("event_type").alias("path"), "value", "us")


@query("leaf_queue_counters", "FN10", """
WITH o AS (SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber > 1) AS nc, count(*) AS n, CAST(sum(CASE WHEN l_linenumber > 1 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS dc, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS da,
 CAST(sum(CASE WHEN l_linenumber > 1 THEN l_partkey ELSE 0 END) AS BIGINT) AS pc, CAST(sum(l_partkey) AS BIGINT) AS pa, min(l_discount) AS md FROM lineitem GROUP BY 1)
SELECT l_orderkey AS port, CASE WHEN md = 0 AND n > 5 THEN NULL WHEN nc > 0 THEN dc ELSE da END AS drops, CASE WHEN md = 0 AND n > 5 THEN NULL WHEN nc > 0 THEN pc ELSE pa END AS packets FROM o""")
def leaf_queue_counters(spark, sf):
    items = V.table(spark, sf, "lineitem")
    number = F.col("l_linenumber")
    row = F.struct(
        F.lit("netem").alias("kind"), F.concat(number.cast("string"), F.lit(":")).alias("handle"), F.when(number > 1, "1:1").alias("parent"),
        F.col("l_quantity").cast("bigint").alias("drops"), F.col("l_partkey").alias("packets"),
    )
    texts = items.groupBy(F.col("l_orderkey").alias("port")).agg(F.to_json(F.collect_list(row)).alias("t"), ((F.min("l_discount") == 0) & (F.count(F.lit(1)) > 5)).alias("cut"))
    text = F.when(F.col("cut"), F.substring("t", 1, 25)).otherwise(F.col("t"))
    return texts.select("port", L.leaf_queues(text).alias("q")).select("port", "q.drops", "q.packets")


@query("counter_texts", "FN11 PRJ13", f"""
SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN CAST(p_partkey * 10 AS BIGINT) END AS rx_bytes, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS BIGINT) END AS tx_drop, {r6('CASE WHEN p_size % 4 <> 0 THEN p_size * 4 / 1.0 END')} AS latency_ms, {r6('p_size % 7 / 1.0')} AS loss_pct,
 CASE p_size % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'down' WHEN 2 THEN 'up' ELSE 'unknown' END AS state,
 CASE WHEN p_size % 4 <> 0 AND p_size * 4 > 150 OR p_size % 7 > 5 THEN 'critical' WHEN p_size % 4 <> 0 AND p_size * 4 > 50 OR p_size % 7 > 1 THEN 'warning' ELSE 'ok' END AS path_health FROM part""")
def counter_texts(spark, sf):
    p = V.table(spark, sf, "part")
    size = F.col("p_size")
    dev = F.concat(
        F.lit("Inter-| Receive\n face |bytes\n    lo: 1 1 0 0 0 0 0 0 1 1 0 0 0 0 0 0\n  eth0: "), (F.col("p_partkey") * 10).cast("string"),
        F.when(size % 3 == 0, " x").otherwise(" 5"), F.lit(" 0 0 0 0 0 0 77 6 0 "), size.cast("string"), F.lit(" 0 0 0 0\n"),
    )
    ping = F.concat(
        F.lit("10 packets transmitted, 9 received, "), (size % 7).cast("string"), F.lit("% packet loss, time 9012ms\n"),
        F.when(size % 4 != 0, F.concat(F.lit("rtt min/avg/max/mdev = 0.041/"), (size * 4).cast("string"), F.lit(".0/900.1/0.013 ms"))).otherwise(""),
    )
    ovs = F.when(size % 4 == 0, "").when(size % 4 == 1, "ovs-ofctl: br0 is not a bridge or a socket").when(size % 4 == 2, " port LOCAL: rx pkts=1").otherwise("hello")
    latency, loss = L.ping_figures(F.col("ping"))
    c = L.interface_counters(F.col("dev"), "eth0")
    t = p.select("p_partkey", dev.alias("dev"), ping.alias("ping"), ovs.alias("ovs"))
    return t.select(
        "p_partkey", c["rx_bytes"].alias("rx_bytes"), c["tx_drop"].alias("tx_drop"), latency.alias("latency_ms"), loss.alias("loss_pct"),
        L.switch_state(F.col("ovs")).alias("state"), path_health(latency, loss).alias("path_health"),
    )


@query("host_health", "PRJ13", f"""
SELECT event_id, CASE WHEN k % 10 = 0 THEN 'critical' WHEN k % 10 = 1 THEN 'unknown' WHEN greatest(value / 8, k / 8.0) > 18 THEN 'critical' WHEN greatest(value / 8, k / 8.0) > 14 THEN 'warning' ELSE 'ok' END AS health FROM ev""")
def host_health_rows(spark, sf):
    state = F.when(F.col("k") % 10 == 0, "down").when(F.col("k") % 10 == 1, "unknown").otherwise("up")
    return V.ev(spark, sf).select("event_id", host_health(state, F.col("value") / 8, F.col("k") / 8.0).alias("health"))


@query("clock_offsets", "FN14", f"""
SELECT user_id, {r6('arg_min(us / 1e6 - value, (k, event_id))')} AS offset_s, min(k) AS rtt_min, count(*) AS n FROM ev GROUP BY user_id""")
def clock_offsets(spark, sf):
    from gaugeline.functions.states import clock_offset

    rows = V.ev(spark, sf).select("user_id", "event_id", (F.col("us") / 1e6 - F.col("k") / 2000.0).alias("a"), (F.col("us") / 1e6 + F.col("k") / 2000.0).alias("b"), F.col("value").alias("p"), "k")
    return rows.groupBy("user_id").agg(clock_offset("a", "b", "p", F.struct("k", "event_id")).alias("offset_s"), F.min("k").alias("rtt_min"), F.count(F.lit(1)).alias("n"))


@query("schedule_levels", "FN15", """
WITH s AS (SELECT run_id, count(*) FILTER (WHERE tick < 20) % 5 AS a, count(*) FILTER (WHERE tick BETWEEN 20 AND 39) % 5 AS b, count(*) FILTER (WHERE tick >= 40) % 5 AS c FROM ev GROUP BY run_id)
SELECT t.run_id, t.tick, CASE WHEN t.tick >= 40 THEN c WHEN t.tick >= 20 THEN b ELSE a END AS level, a <> b AS changes FROM (SELECT DISTINCT run_id, tick FROM cells) t JOIN s USING (run_id)""")
def schedule_levels(spark, sf):
    from gaugeline.functions.states import level_at

    rows = V.ev(spark, sf)
    part = lambda lo, hi: (F.count_if(F.col("tick").between(lo, hi)) % 5)
    plan = F.array(*[F.struct(F.lit(s).alias("start"), part(s, e).alias("level")) for s, e in ((0, 19), (20, 39), (40, 10**9))])
    sched = rows.groupBy("run_id").agg(plan.alias("sched"))
    ticks = rows.select("run_id", "tick").distinct()
    at = lambda t: level_at(F.col("sched"), t)
    return ticks.join(sched, "run_id").select("run_id", "tick", at(F.col("tick")).alias("level"), (F.size(F.array_distinct(F.array(at(F.lit(10)), at(F.lit(30))))) > 1).alias("changes"))


@query("distinct_values", "SET4", "SELECT event_type, count(DISTINCT user_id) AS n_users, count(DISTINCT k) AS n_k FROM ev GROUP BY event_type")
def distinct_values(spark, sf):
    return V.ev(spark, sf).groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("k").alias("n_k"))


@query("recent_history", "SRT5", "SELECT event_id, us FROM ev ORDER BY us DESC, event_id DESC LIMIT 200")
def recent_history(spark, sf):
    return V.ev(spark, sf).select("event_id", "us").orderBy(F.desc("us"), F.desc("event_id")).limit(200)
