"""Alarm machine, suppression, guard, ordered ingest and freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import alarm as A
from gaugeline.operators import bitmaps as B
from gaugeline.operators import capacity as P
from gaugeline.operators import freshness as R
from gaugeline.operators import intervals as I
from gaugeline.operators import quantiles as Q
from gaugeline.operators import scan as S
from gaugeline.plans import envelope as E
from gaugeline.plans import network as N
from gaugeline.plans import views as V
from gaugeline.plans.registry import query, r6
from gaugeline.plans.views import SQL_VIEWS, _machine
from gaugeline.session import cut_lineage

USER = ["user_id"]
ALARM_SQL = "('suspect', 'act')"


def chunk():
    return S.tick_chunk("tick")


def trace(spark, sf):
    """State per reading, written once because the figures below read it several times."""
    stepped = A.states(V.readings(spark, sf), USER, ["tick"], chunk())
    return cut_lineage(stepped.select("user_id", "tick", "us", "status", "suspect", "act", "state", "prev", "entry"))


@query("alarm_states", "ST3", "SELECT user_id, tick, state, prev FROM trace")
def alarm_states(spark, sf):
    return A.states(V.readings(spark, sf), USER, ["tick"], chunk()).select("user_id", "tick", "state", "prev")


def held_readings(spark, sf):
    base = V.readings(spark, sf)
    zones = base.where("k % 20 = 5").select("user_id", "event_type", F.col("us").alias("z0"), (F.col("us") + 86400000000).alias("z1"))
    counted = I.active_counts(base, zones, ["user_id", "event_type"], "us", "z0", "z1")
    held = counted.withColumn("held", (F.col("suspect") | F.col("act")) & (F.col("n_active") > 0))
    return cut_lineage(held.select("user_id", "tick", "us", "status", "suspect", "act", "held"))


@query("suppressed_states", "ST4 JN4", "SELECT user_id, tick, state, prev FROM trace_s")
def suppressed_states(spark, sf):
    return A.states(held_readings(spark, sf), USER, ["tick"], chunk(), suppressed=F.col("held")).select("user_id", "tick", "state", "prev")


@query("alarm_entries", "WIN7", f"""
WITH x AS (SELECT *, lag(status = 'scored' AND (suspect OR act)) OVER (PARTITION BY user_id ORDER BY tick) AS praw FROM trace)
SELECT user_id, count(*) FILTER (WHERE state IN {ALARM_SQL} AND prev NOT IN {ALARM_SQL}) AS n_entries,
 count(*) FILTER (WHERE status = 'scored' AND (suspect OR act) AND NOT coalesce(praw, false)) AS n_raw_runs,
 count(*) FILTER (WHERE status = 'scored' AND prev NOT IN {ALARM_SQL}) AS at_risk FROM x GROUP BY user_id""")
def alarm_entries(spark, sf):
    moved = trace(spark, sf)
    raw = (F.col("status") == "scored") & (F.col("suspect") | F.col("act"))
    told = S.scan(moved, USER, ["tick"], chunk(), praw=S.previous(raw))
    return told.groupBy("user_id").agg(
        F.count_if("entry").alias("n_entries"), F.count_if(raw & ~F.coalesce("praw", F.lit(False))).alias("n_raw_runs"),
        F.count_if((F.col("status") == "scored") & ~F.col("prev").isin(*A.ALARM)).alias("at_risk"),
    )


@query("oscillation", "WIN11 WIN12", """
WITH s AS (SELECT user_id, tick, state, CASE state WHEN 'normal' THEN 0 WHEN 'suspect' THEN 1 WHEN 'act' THEN 2 END AS v FROM trace),
a AS (SELECT user_id, count(*) FILTER (WHERE state = 'act' AND p IS DISTINCT FROM 'act') AS act_entries FROM (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY tick) AS p FROM s) GROUP BY user_id),
c AS (SELECT * FROM (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY tick) AS p FROM s WHERE v IS NOT NULL) WHERE p IS NULL OR p <> v),
d AS (SELECT *, lag(v, 2) OVER (PARTITION BY user_id ORDER BY tick) AS pp, max(CASE WHEN v < p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fell FROM c),
e AS (SELECT user_id, count(*) FILTER (WHERE v > p AND fell = 1) AS reescalations, count(*) FILTER (WHERE pp = v AND v >= 1) AS v1_violations FROM d GROUP BY user_id)
SELECT a.user_id, act_entries, coalesce(reescalations, 0) AS reescalations, coalesce(v1_violations, 0) AS v1_violations,
 act_entries <= 1 AND coalesce(reescalations, 0) = 0 AS passed FROM a LEFT JOIN e USING (user_id)""")
def oscillation(spark, sf):
    out = A.entries_and_rises(trace(spark, sf), USER, ["tick"], chunk())
    return out.withColumn("passed", (F.col("act_entries") <= 1) & (F.col("reescalations") == 0))


@query("false_positive_ticks", "WIN13 AG38", """
WITH w AS (SELECT user_id, arg_max(tick, value) AS t0 FROM readings GROUP BY user_id),
f AS (SELECT t.user_id, t.tick, t.state FROM trace t JOIN w USING (user_id) WHERE t.tick >= 1 AND NOT (t.tick > t0 AND t.tick <= t0 + 8) AND state IN ('suspect', 'act')),
c AS (SELECT user_id, tick, state, tick - row_number() OVER (PARTITION BY user_id ORDER BY tick) AS g FROM f)
SELECT user_id, count(*) AS fp_ticks, count(DISTINCT g) AS fp_events, count(*) FILTER (WHERE state = 'act') AS act_fp_ticks FROM c GROUP BY user_id""")
def false_positive_ticks(spark, sf):
    start = V.readings(spark, sf).groupBy("user_id").agg(F.max_by("tick", "value").alias("t0"))
    labelled = trace(spark, sf).join(start, "user_id")
    quiet = ~((F.col("tick") > F.col("t0")) & (F.col("tick") <= F.col("t0") + 8))
    bad = S.islands(labelled.where((F.col("tick") >= 1) & quiet & F.col("state").isin(*A.ALARM)), USER, "tick")
    spans = bad.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "act").alias("na"))
    return spans.groupBy("user_id").agg(F.sum("n").alias("fp_ticks"), F.count(F.lit(1)).alias("fp_events"), F.sum("na").alias("act_fp_ticks"))


SQL_VIEWS["readings_c"] = """SELECT user_id * 4 + c AS user_id, tick, us, status, CASE WHEN c // 2 = 0 THEN suspect ELSE act END AS suspect, act,
  held AND c % 2 = 1 AND (act OR CASE WHEN c // 2 = 0 THEN suspect ELSE act END) AS held FROM readings_s CROSS JOIN (VALUES (0), (1), (2), (3)) v(c)"""
SQL_VIEWS["trace_c"] = _machine("readings_c", "trace_c", "(r.status = 'scored' AND NOT r.held)")


@query("channel_machines", "ST11 AG37", f"""
SELECT user_id // 4 AS user_id, CASE WHEN user_id % 4 // 2 = 0 THEN 'full' ELSE 'act_only' END AS channel, CASE WHEN user_id % 2 = 1 THEN 'with_log' ELSE 'no_log' END AS mode,
 count(*) FILTER (WHERE state IN {ALARM_SQL} AND prev NOT IN {ALARM_SQL}) AS n_entries, count(*) FILTER (WHERE status = 'scored' AND prev NOT IN {ALARM_SQL}) AS at_risk,
 count(*) FILTER (WHERE state IN {ALARM_SQL}) AS alarm_ticks, count(*) FILTER (WHERE status = 'scored' AND (suspect OR act)) AS raw_ticks FROM trace_c GROUP BY 1, 2, 3""")
def channel_machines(spark, sf):
    """Four machines over one read of the readings."""
    named = {("full", "no_log"): (F.col("suspect"), None), ("full", "with_log"): (F.col("suspect"), F.col("held")),
             ("act_only", "no_log"): (F.col("act"), None), ("act_only", "with_log"): (F.col("act"), F.col("held"))}
    symbols = {f"{c}_{m}": A.symbol(suspect, F.col("act"), held) for (c, m), (suspect, held) in named.items()}
    rows = A.channels(held_readings(spark, sf), USER, ["tick"], chunk(), symbols)
    told = F.explode(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.lit(m).alias("mode"), suspect.alias("suspect"), F.col(f"{c}_{m}").alias("state"), F.col(f"{c}_{m}_prev").alias("prev")) for (c, m), (suspect, _) in named.items()
    ])).alias("_m")
    moved = rows.select("user_id", "status", "act", told).select("user_id", "status", "act", "_m.*").withColumns(A.moves("state", "prev"))
    return moved.groupBy("user_id", "channel", "mode").agg(
        F.count_if("entry").alias("n_entries"), F.count_if((F.col("status") == "scored") & ~F.col("prev").isin(*A.ALARM)).alias("at_risk"),
        F.count_if(F.col("state").isin(*A.ALARM)).alias("alarm_ticks"),
        F.count_if((F.col("status") == "scored") & (F.col("suspect") | F.col("act"))).alias("raw_ticks"),
    )


# Replays apply the rule of the statuses to the rows that are left; no status is written where they are cut.
SQL_VIEWS["readings_r"] = """SELECT user_id * 2 + i AS user_id, row_number() OVER (PARTITION BY user_id, i ORDER BY tick) - 1 AS tick, us, CASE WHEN row_number() OVER (PARTITION BY user_id, i ORDER BY tick) = 1 THEN 'warming_up'
  WHEN tick - lag(tick) OVER (PARTITION BY user_id, i ORDER BY tick) > 1 OR k % 11 = 0 THEN 'unknown' ELSE 'scored' END AS status, suspect, act FROM readings CROSS JOIN (VALUES (0, 5), (1, 15)) v(i, cp) WHERE tick >= cp"""
SQL_VIEWS["trace_r"] = _machine("readings_r", "trace_r")
SQL_VIEWS["readings_g"] = """SELECT user_id, row_number() OVER w - 1 AS tick, tick AS us, CASE WHEN row_number() OVER w = 1 THEN 'warming_up' WHEN tick - lag(tick) OVER w > 1 OR k % 11 = 0 THEN 'unknown' ELSE 'scored' END AS status,
  suspect, act FROM readings WHERE tick < 10 OR tick >= 15 WINDOW w AS (PARTITION BY user_id ORDER BY tick)"""
SQL_VIEWS["trace_g"] = _machine("readings_g", "trace_g")


@query("restart_replay", "ST12", """
SELECT user_id // 2 AS user_id, CASE WHEN user_id % 2 = 0 THEN 5 ELSE 15 END AS restart, bool_or(tick = 0 AND state = 'warming_up') AS starts_warming,
 coalesce(bool_or(tick = 1 AND state = 'act'), false) AS early_act, count(*) FILTER (WHERE state = 'act') AS act_ticks FROM trace_r GROUP BY ALL""")
def restart_replay(spark, sf):
    points = F.explode(F.array(F.lit(5), F.lit(15))).alias("restart")
    rows = V.readings(spark, sf).drop("status").select("*", points).where("tick >= restart")
    keys = ["user_id", "restart"]
    judged = A.with_status(rows, keys, ["tick"], chunk(), "tick", F.col("k") % 11 == 0)
    first = F.col("tick") == F.col("restart")
    return A.states(judged, keys, ["tick"], chunk()).groupBy(*keys).agg(
        F.bool_or(first & (F.col("state") == "warming_up")).alias("starts_warming"),
        F.bool_or((F.col("tick") == F.col("restart") + 1) & (F.col("state") == "act")).alias("early_act"),
        F.count_if(F.col("state") == "act").alias("act_ticks"),
    )


@query("gap_replay", "ST13", """
SELECT user_id, coalesce(bool_or(us = 15 AND state = 'unknown'), false) AS gap_unknown, count(*) FILTER (WHERE state = 'act') AS act_ticks,
 count(*) FILTER (WHERE state IN ('suspect', 'act') AND us >= 15) AS alarms_after FROM trace_g GROUP BY user_id""")
def gap_replay(spark, sf):
    rows = V.readings(spark, sf).drop("status").where("tick < 10 or tick >= 15")
    judged = A.with_status(rows, USER, ["tick"], chunk(), "tick", F.col("k") % 11 == 0)
    return A.states(judged, USER, ["tick"], chunk()).groupBy("user_id").agg(
        F.coalesce(F.bool_or((F.col("cause") == "gap") & (F.col("state") == "unknown")), F.lit(False)).alias("gap_unknown"),
        F.count_if(F.col("state") == "act").alias("act_ticks"),
        F.count_if(F.col("state").isin(*A.ALARM) & (F.col("tick") >= 15)).alias("alarms_after"),
    )


@query("ordered_ingest", "ST1", """
WITH a AS (SELECT user_id, event_id, tick, us // 7200000000 + k % 3 AS t, event_type AS d FROM series),
b AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a),
c AS (SELECT *, CASE WHEN top IS NULL OR t > top THEN 'accepted' WHEN t < top THEN 'late' ELSE 'same' END AS kind FROM b),
e AS (SELECT *, last_value(CASE WHEN kind = 'accepted' THEN d END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ld FROM c)
SELECT user_id, event_id, CASE WHEN kind <> 'same' THEN kind WHEN ld = d THEN 'duplicate' ELSE 'conflict' END AS verdict FROM e""")
def ordered_ingest(spark, sf):
    rows = V.series(spark, sf).withColumn("t", F.floor(F.col("us") / 7200000000).cast("bigint") + F.col("k") % 3)
    return A.accepted(rows, USER, ["tick"], chunk(), "t", "event_type").select("user_id", "event_id", "verdict")


@query("reading_status", "ST2", """
WITH a AS (SELECT user_id, event_id, tick, us, us // 7200000000 + k % 3 AS t, k, value FROM series),
b AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a),
c AS (SELECT *, t - lag(t) OVER w AS gap, row_number() OVER w - 1 AS i FROM b WHERE top IS NULL OR t > top WINDOW w AS (PARTITION BY user_id ORDER BY tick))
SELECT user_id, event_id, CASE WHEN i < 1 THEN 'warming_up' WHEN k % 13 = 0 THEN 'unknown:version' WHEN gap NOT BETWEEN 1 AND 10 THEN 'unknown:gap'
 WHEN k % 11 = 0 THEN 'unknown:missing' ELSE 'scored' END AS status FROM c""")
def reading_status(spark, sf):
    rows = V.series(spark, sf).withColumn("t", F.floor(F.col("us") / 7200000000).cast("bigint") + F.col("k") % 3)
    taken = A.accepted(rows, USER, ["tick"], chunk(), "t", "event_type").where("verdict = 'accepted'")
    told = S.scan(taken, USER, ["tick"], chunk(), p=S.previous(F.col("t")), i=S.count(before=True))
    gap = F.col("t") - F.col("p")
    status = (
        F.when(F.col("i") < 1, "warming_up").when(F.col("k") % 13 == 0, "unknown:version")
        .when(~gap.between(1, 10), "unknown:gap").when(F.col("k") % 11 == 0, "unknown:missing").otherwise("scored")
    )
    return told.select("user_id", "event_id", status.alias("status"))


SQL_VIEWS["loads"] = """SELECT run_id, g, row_number() OVER (PARTITION BY run_id ORDER BY tick) - 1 AS rn, tick, load, affected FROM (
  SELECT run_id, g, tick, CASE WHEN count(*) FILTER (WHERE ok) = (SELECT count(DISTINCT entity) FROM ev) THEN min(rate) END AS load,
  coalesce(string_agg(CASE WHEN ok AND (rate < lo OR rate > hi) THEN entity END, ',' ORDER BY entity), '') AS affected FROM cells JOIN bounds USING (entity) GROUP BY run_id, g, tick)"""
SQL_VIEWS["guards"] = """SELECT g, rn, tick, coalesce(load > 50, false) AS active, CAST(0 AS BIGINT) AS calm FROM loads WHERE rn = 0
  UNION ALL SELECT r.g, r.rn, r.tick, CASE WHEN load IS NULL THEN active WHEN load > 50 THEN true WHEN active AND calm + 1 >= 3 THEN false ELSE active END AS active,
  CASE WHEN load IS NULL THEN calm WHEN load > 50 THEN 0 WHEN active AND calm + 1 >= 3 THEN 0 WHEN active THEN calm + 1 ELSE calm END AS calm
  FROM guards m JOIN loads r ON r.g = m.g AND r.rn = m.rn + 1"""
SQL_VIEWS["readings_n"] = """SELECT s.g AS user_id, s.rn AS tick, s.tick AS us, CASE WHEN s.rn < 1 THEN 'warming_up' WHEN s.gap > 1 OR NOT x.judgeable THEN 'unknown' ELSE 'scored' END AS status,
  x.judgeable AND x.k > 0 AS suspect, x.judgeable AND x.k > 1 AS act FROM (SELECT *, tick - lag(tick) OVER (PARTITION BY run_id ORDER BY tick) AS gap FROM loads) s JOIN scores x ON x.run_id = s.run_id AND x.tick = s.tick"""
SQL_VIEWS["trace_n"] = _machine("readings_n", "trace_n")


def run_loads(spark, sf):
    cells = V.cells(spark, sf).join(E.bounds(spark, sf), "entity")
    out = F.col("ok") & ((F.col("rate") < F.col("lo")) | (F.col("rate") > F.col("hi")))
    return cut_lineage(cells.groupBy("run_id", "tick").agg(
        F.when(F.count_if("ok") == V.n_entities(spark, sf), F.min("rate")).alias("load"),
        F.array_join(F.array_sort(F.collect_set(F.when(out, F.col("entity")))), ",").alias("affected"),
    ))


def run_readings(spark, sf):
    scored = cut_lineage(E.scores(spark, sf).select("run_id", "tick", "k", "judgeable"))
    told = S.scan(scored, ["run_id"], ["tick"], chunk(), True, i=S.count(before=True), p=S.previous(F.col("tick")))
    status = (
        F.when(F.col("i") < 1, "warming_up").when((F.col("tick") - F.col("p") > 1) | ~F.col("judgeable"), "unknown").otherwise("scored")
    )
    good = F.col("judgeable")
    return told.select("run_id", "tick", status.alias("status"), (good & (F.col("k") > 0)).alias("suspect"), (good & (F.col("k") > 1)).alias("act"))


# Every 20th event of a run is an intervention on a link, transient or lasting; a lasting one is reverted
# two ticks later or stays an open lease. Its zone is the radius of the link over the routes of heavy flows.
SQL_VIEWS["covered"] = """SELECT v.run_id, v.g, v.tick, count(*) AS n_violating, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM acts_z a JOIN zone_z z USING (target)
    WHERE a.run_id = v.run_id AND z.entity = v.entity AND a.s <= v.tick AND v.tick < a.e)) AS n_covered
  FROM viol_z v GROUP BY ALL"""
SQL_VIEWS["readings_y"] = """SELECT g AS user_id, row_number() OVER (PARTITION BY g ORDER BY tick) - 1 AS tick, tick AS us, CASE WHEN lag(tick) OVER (PARTITION BY g ORDER BY tick) IS NULL THEN 'warming_up'
  WHEN tick - lag(tick) OVER (PARTITION BY g ORDER BY tick) > 1 THEN 'unknown' ELSE 'scored' END AS status, high > 60 AS suspect, high > 100 AS act FROM (SELECT g, tick, max(value) AS high FROM ev GROUP BY g, tick)"""
SQL_VIEWS["readings_z"] = """SELECT r.*, coalesce((suspect OR act) AND n_covered = n_violating, false) AS held FROM readings_y r LEFT JOIN covered c ON c.g = r.user_id AND c.tick = r.us"""
SQL_VIEWS["trace_z"] = _machine("readings_z", "trace_z", "(r.status = 'scored' AND NOT r.held)")


def zone_cover(spark, sf):
    """(run_id, tick, n_violating, n_covered, suppressed): all violating switches lie in the union of the
    zones of the active interventions."""
    zones, numbers = N.switch_zones(spark, sf)
    spans = N.link_acts(spark, sf).select("run_id", "target", "s", "e")
    violating = cut_lineage(N.violating_switches(spark, sf))
    sets = B.bitmaps(violating.join(numbers, "entity"), ["run_id", "tick"])
    active = B.active_zones(violating, spans, zones, ["run_id"], "tick", "s", "e", "target")
    told = B.contained(sets, active, ["run_id", "tick"]).withColumnsRenamed({"n_members": "n_violating", "n_inside": "n_covered"})
    return cut_lineage(told.withColumn("suppressed", F.col("n_covered") == F.col("n_violating")))


@query("radius_suppression", "ST4 JN4 GR3", "SELECT run_id, tick, n_violating, n_covered, n_covered = n_violating AS suppressed FROM covered")
def radius_suppression(spark, sf):
    return zone_cover(spark, sf)


def switch_readings(spark, sf):
    """(run_id, tick, status, suspect, act) over the devices of a run."""
    ticks = V.ev(spark, sf).groupBy("run_id", "tick").agg(F.max("value").alias("high"))
    told = S.scan(cut_lineage(ticks), ["run_id"], ["tick"], chunk(), True, p=S.previous(F.col("tick")))
    status = F.when(F.col("p").isNull(), "warming_up").when(F.col("tick") - F.col("p") > 1, "unknown").otherwise("scored")
    return told.select("run_id", "tick", status.alias("status"), (F.col("high") > 60).alias("suspect"), (F.col("high") > 100).alias("act"))


def zone_trace(spark, sf):
    told = switch_readings(spark, sf).join(zone_cover(spark, sf).select("run_id", "tick", "suppressed"), ["run_id", "tick"], "left")
    held = (F.col("suspect") | F.col("act")) & F.coalesce("suppressed", F.lit(False))
    return A.states(told.withColumn("held", held), ["run_id"], ["tick"], chunk(), suppressed=F.col("held"))


@query("radius_suppressed_states", "ST4 ST14", """SELECT 'R' || lpad(CAST(t.user_id AS VARCHAR), 6, '0') AS run_id, t.us AS tick, t.state, t.prev, r.held FROM trace_z t JOIN readings_z r USING (user_id, tick)""")
def radius_suppressed_states(spark, sf):
    return zone_trace(spark, sf).select("run_id", "tick", "state", "prev", "held")


@query("suppression_window", "ST14", """
WITH w AS (SELECT run_id, min(s) AS t0 FROM acts_z GROUP BY run_id)
SELECT w.run_id, count(*) FILTER (WHERE t.state = 'act' AND t.prev <> 'act') AS act_entries, count(*) FILTER (WHERE r.held AND t.status = 'scored') AS n_suppressed,
  count(*) FILTER (WHERE (t.suspect OR t.act) AND NOT r.held AND t.status = 'scored') AS n_spoke, count(*) FILTER (WHERE t.state = 'unknown') AS n_unknown
FROM trace_z t JOIN readings_z r USING (user_id, tick) JOIN w ON w.run_id = 'R' || lpad(CAST(t.user_id AS VARCHAR), 6, '0') WHERE t.us BETWEEN t0 AND t0 + 16 GROUP BY w.run_id""")
def suppression_window(spark, sf):
    """Act entries and suppressed ticks of each run within 16 ticks of its first intervention."""
    start = N.link_acts(spark, sf).groupBy("run_id").agg(F.min("s").alias("t0"))
    inside = zone_trace(spark, sf).join(start, "run_id").where("tick between t0 and t0 + 16")
    scored, alarming = F.col("status") == "scored", F.col("suspect") | F.col("act")
    return inside.groupBy("run_id").agg(
        F.count_if((F.col("state") == "act") & (F.col("prev") != "act")).alias("act_entries"), F.count_if(F.col("held") & scored).alias("n_suppressed"),
        F.count_if(alarming & ~F.col("held") & scored).alias("n_spoke"), F.count_if(F.col("state") == "unknown").alias("n_unknown"),
    )


@query("guard_feasibility", "AG41", f"""
SELECT l.run_id, count(*) AS n_ticks, count(load) AS n_judgeable, count(*) FILTER (WHERE active AND load IS NOT NULL) AS n_guard_active,
 {r6('count(*) FILTER (WHERE active AND load IS NOT NULL) / nullif(count(load), 0)')} AS frac_guard_active, {r6('median(round(load, 4))')} AS load_median
FROM loads l JOIN guards m ON m.g = l.g AND m.rn = l.rn GROUP BY l.run_id""")
def guard_feasibility(spark, sf):
    out = cut_lineage(A.range_guard(run_loads(spark, sf), ["run_id"], ["tick"], chunk(), "load", F.lit(50.0), 3).select("run_id", "tick", "load", "guard"))
    per = out.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_ticks"), F.count("load").alias("n_judgeable"), F.count_if(F.col("guard") & F.col("load").isNotNull()).alias("n_guard_active"))
    middle = Q.quantiles(out.withColumn("load", F.round("load", 4)), ["run_id"], "load", {"load_median": ("middle", 0.5)})
    share = F.try_divide(F.col("n_guard_active").cast("double"), F.col("n_judgeable").cast("double"))
    return per.withColumn("frac_guard_active", share).join(middle, "run_id", "left")


@query("range_guard", "ST5", f"""
SELECT 'R' || lpad(CAST(l.g AS VARCHAR), 6, '0') AS run_id, l.tick, {r6('load')} AS load, active AS guard FROM loads l JOIN guards m ON m.g = l.g AND m.rn = l.rn""")
def range_guard(spark, sf):
    out = A.range_guard(run_loads(spark, sf), ["run_id"], ["tick"], chunk(), "load", F.lit(50.0), 3)
    return out.select("run_id", "tick", "load", "guard")


@query("published_states", "ST6 ST19", """
WITH p AS (SELECT l.run_id, l.tick, l.rn, t.state, m.active AS guard, l.affected,
  CASE WHEN m.active AND t.state IN ('normal', 'suspect', 'act') THEN 'unknown' ELSE t.state END AS published
  FROM loads l JOIN trace_n t ON t.user_id = l.g AND t.tick = l.rn JOIN guards m ON m.g = l.g AND m.rn = l.rn),
c AS (SELECT *, CASE WHEN published IS DISTINCT FROM lag(published) OVER (PARTITION BY run_id ORDER BY tick) THEN tick END AS chg FROM p)
SELECT run_id, tick, state, published, CASE WHEN guard AND state IN ('normal', 'suspect', 'act') THEN 'out_of_operating_range' ELSE '' END AS cause, affected,
 last_value(chg IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY tick) AS detected_at FROM c""")
def published_states(spark, sf):
    stepped = A.states(run_readings(spark, sf), ["run_id"], ["tick"], chunk()).select("run_id", "tick", "state")
    guarded = A.range_guard(run_loads(spark, sf), ["run_id"], ["tick"], chunk(), "load", F.lit(50.0), 3)
    both = cut_lineage(stepped.join(guarded, ["run_id", "tick"]))
    over = F.col("guard") & F.col("state").isin("normal", "suspect", "act")
    out = both.select(
        "run_id", "tick", "state", F.when(over, "unknown").otherwise(F.col("state")).alias("published"),
        F.when(over, "out_of_operating_range").otherwise("").alias("cause"), "affected",
    )
    told = S.scan(out, ["run_id"], ["tick"], chunk(), p=S.previous(F.col("published")))
    moved = F.when(~F.col("p").eqNullSafe(F.col("published")), F.col("tick"))
    return S.scan(told.withColumn("m", moved), ["run_id"], ["tick"], chunk(), detected_at=S.last_known(F.col("m"))).drop("p", "m")


SQL_VIEWS["msgs"] = """SELECT user_id, tick, us, 'b' || CAST(tick // 6 - CASE WHEN k % 10 = 0 AND tick >= 6 THEN 1 ELSE 0 END AS VARCHAR) AS boot, tick * 2 + k % 5 AS seq FROM series"""
SQL_VIEWS["mono"] = """SELECT user_id, tick, us, boot, seq, boot AS cur, seq AS cseq, CAST([] AS VARCHAR[]) AS retired, true AS accepted, CAST(NULL AS BIGINT) AS conf FROM msgs WHERE tick = 0
  UNION ALL SELECT user_id, tick, us, boot, seq, CASE WHEN ok THEN boot ELSE cur END AS cur, CASE WHEN ok THEN seq ELSE cseq END AS cseq,
  CASE WHEN ok AND boot <> cur THEN list_append(retired, cur) ELSE retired END AS retired, ok AS accepted, CASE WHEN ok THEN us ELSE conf END AS conf
  FROM (SELECT r.*, m.cur, m.cseq, m.retired, m.conf, CASE WHEN r.boot = m.cur THEN r.seq > m.cseq ELSE NOT list_contains(m.retired, r.boot) END AS ok
  FROM mono m JOIN msgs r ON r.user_id = m.user_id AND r.tick = m.tick + 1)"""


@query("monotone_reads", "ST7", "SELECT user_id, tick, accepted, coalesce(us - conf > 43200000000, true) AS stale FROM mono")
def monotone_reads(spark, sf):
    rows = V.series(spark, sf)
    back = F.when((F.col("k") % 10 == 0) & (F.col("tick") >= 6), 1).otherwise(0)
    boot = F.concat(F.lit("b"), (F.floor(F.col("tick") / 6) - back).cast("string"))
    msgs = rows.select("user_id", "tick", "us", boot.alias("boot"), (F.col("tick") * 2 + F.col("k") % 5).alias("seq"))
    out = R.monotone(msgs, USER, ["tick"], chunk(), "boot", "seq", "us")
    return out.select("user_id", "tick", "accepted", R.stale(F.col("us"), F.col("confirmed_at"), 43200e6).alias("stale"))


@query("read_cache", "ST9", f"""
WITH c AS (SELECT run_id, entity, tick, CASE WHEN rate >= 200 THEN rate END AS v FROM cells),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY run_id, entity ORDER BY tick) AS filled FROM c),
t AS (SELECT run_id, tick, count(v) = 0 AS all_failed, count(*) FILTER (WHERE v IS NULL AND filled IS NOT NULL) AS n_stale, {r6('sum(filled)')} AS filled_sum FROM f GROUP BY run_id, tick),
g AS (SELECT *, row_number() OVER w - max(CASE WHEN NOT all_failed THEN rn ELSE 0 END) OVER w AS fails FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY tick) AS rn FROM t) WINDOW w AS (PARTITION BY run_id ORDER BY tick))
SELECT run_id, tick, n_stale, filled_sum, fails AS consecutive_fails, fails >= 3 AS aborted FROM g""")
def read_cache(spark, sf):
    reads = V.cells(spark, sf).withColumn("v", F.when(F.col("rate") >= 200, F.col("rate")))
    filled = R.forward_fill(reads, ["run_id", "entity"], ["tick"], chunk(), "v")
    cycles = filled.groupBy("run_id", "tick").agg(
        (F.count("v") == 0).alias("all_failed"), F.count_if("stale").alias("n_stale"), F.sum("filled").alias("filled_sum")
    )
    out = S.streaks(cycles, ["run_id"], ["tick"], chunk(), {"consecutive_fails": F.col("all_failed")})
    return out.select("run_id", "tick", "n_stale", "filled_sum", "consecutive_fails", (F.col("consecutive_fails") >= 3).alias("aborted"))


@query("conflated_mailbox", "ST10", f"""
SELECT user_id, us // 86400000000 AS day, {r6('arg_max(value, tick)')} AS value, max(tick) AS tick, count(*) - 1 AS overwritten FROM series GROUP BY 1, 2""")
def conflated_mailbox(spark, sf):
    rows = V.series(spark, sf).withColumn("day", F.floor(F.col("us") / 86400000000))
    return R.conflate(rows, ["user_id", "day"], "tick", "value")


@query("redelivered_messages", "ST17", """
SELECT user_id, event_id, tick FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY tick) AS r FROM series) WHERE r = 1 OR k % 10 = 0""")
def redelivered_messages(spark, sf):
    rows = V.series(spark, sf).select("user_id", F.when(F.col("k") % 10 != 0, F.col("k")).alias("cid"), "tick", "event_id")
    return R.first_results(rows, ["user_id"], "cid", ["tick"]).select("user_id", "event_id", "tick")


@query("expired_leases", "ST18", """
SELECT user_id, event_type AS target, us + 172800000000 AS expired_at FROM (SELECT *, lead(us) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS nx FROM series)
WHERE nx IS NULL OR nx > us + 172800000000""")
def expired_leases(spark, sf):
    rows = V.ev(spark, sf)
    chunk = S.range_chunk("us", S.even_width(rows, ["user_id", "event_type"], "us"))
    out = R.lease_expiries(rows, ["user_id", "event_type"], ["us", "event_id"], chunk, "us", 172800e6)
    return out.select("user_id", F.col("event_type").alias("target"), F.col("expired_at").cast("bigint").alias("expired_at"))


SQL_VIEWS["obs"] = """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY tick) - 1 AS i, tick, value / 100.0 AS rho, k % 4 = 0 AS down FROM series WHERE k % 9 <> 0"""
SQL_VIEWS["caps"] = """SELECT user_id, i, tick, CASE WHEN rho > 0.8 THEN 1 ELSE 0 END AS hi, CASE WHEN rho < 0.3 THEN 1 ELSE 0 END AS lo, CASE WHEN down THEN 1 ELSE 0 END AS dn,
  CASE WHEN down THEN 0 ELSE 1 END AS up, 0 AS load, 0 AS fail FROM obs WHERE i = 0
  UNION ALL SELECT user_id, i, tick, hi, lo, dn, up, CASE WHEN hi >= 3 THEN 1 WHEN lo >= 3 THEN 0 ELSE load END AS load, CASE WHEN dn >= 2 THEN 1 WHEN up >= 3 THEN 0 ELSE fail END AS fail
  FROM (SELECT o.user_id, o.i, o.tick, CASE WHEN rho > 0.8 THEN m.hi + 1 ELSE 0 END AS hi, CASE WHEN rho < 0.3 THEN m.lo + 1 ELSE 0 END AS lo,
  CASE WHEN down THEN m.dn + 1 ELSE 0 END AS dn, CASE WHEN down THEN 0 ELSE m.up + 1 END AS up, m.load, m.fail FROM caps m JOIN obs o ON o.user_id = m.user_id AND o.i = m.i + 1)"""


@query("wanted_capacity", "ST15", "SELECT user_id, tick, CAST(load AS BIGINT) AS load, CAST(fail AS BIGINT) AS failover, CAST(least(2, load + fail) AS BIGINT) AS target FROM caps")
def wanted_capacity(spark, sf):
    rows = V.series(spark, sf).select("user_id", "tick", "k", (F.col("value") / 100.0).alias("rho"), (F.col("k") % 4 == 0).alias("down"))
    out = P.wanted_level(rows, USER, ["tick"], chunk(), "rho", "down", F.col("k") % 9 != 0)
    return out.select("user_id", "tick", "load", "failover", "target")


@query("scored_set", "AG37 ST6", """
SELECT r.grp, l.run_id, count(*) AS n_ticks, count(*) FILTER (WHERE m.active) AS guard_ticks, count(*) FILTER (WHERE t.state IN ('suspect', 'act')) AS raw_alarm_ticks,
 count(*) FILTER (WHERE t.state IN ('suspect', 'act') AND NOT m.active) AS published_alarm_ticks, count(*) FILTER (WHERE t.state IN ('suspect', 'act') AND t.prev NOT IN ('suspect', 'act')) AS n_entries
FROM loads l JOIN trace_n t ON t.user_id = l.g AND t.tick = l.rn JOIN guards m ON m.g = l.g AND m.rn = l.rn JOIN runs r ON r.run_id = l.run_id GROUP BY r.grp, l.run_id""")
def scored_set(spark, sf):
    moved = A.states(run_readings(spark, sf), ["run_id"], ["tick"], chunk()).select("run_id", "tick", "state", "entry")
    guarded = A.range_guard(run_loads(spark, sf), ["run_id"], ["tick"], chunk(), "load", F.lit(50.0), 3).select("run_id", "tick", "guard")
    rows = moved.join(guarded, ["run_id", "tick"]).join(V.runs(spark, sf).select("run_id", "grp"), "run_id")
    alarm = F.col("state").isin(*A.ALARM)
    return rows.groupBy("grp", "run_id").agg(
        F.count(F.lit(1)).alias("n_ticks"), F.count_if("guard").alias("guard_ticks"), F.count_if(alarm).alias("raw_alarm_ticks"),
        F.count_if(alarm & ~F.col("guard")).alias("published_alarm_ticks"), F.count_if("entry").alias("n_entries"),
    )
