"""Latency, jitter, A/B blocks, trials, freshness figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import intervals as I
from gaugeline.operators import latency as T
from gaugeline.operators import matching as M
from gaugeline.operators import pools as P
from gaugeline.operators import quantiles as Q
from gaugeline.operators import ranking as R
from gaugeline.operators import scan as S
from gaugeline.plans import views as V
from gaugeline.plans.registry import query, r6
from gaugeline.plans.views import SQL_VIEWS
from gaugeline.session import cut_lineage, fresh_path
from gaugeline.sources import logs as L

SUMMARY = f"""count(*) AS n, {r6('avg(v)')} AS mean, {r6('median(v)')} AS p50, {r6('quantile_disc(v, 0.95)')} AS p95, {r6('quantile_disc(v, 0.99)')} AS p99, {r6('max(v)')} AS max, {r6('min(v)')} AS min"""


@query("latency_summary", "AG47", f"SELECT event_type, {SUMMARY} FROM (SELECT event_type, value AS v FROM events) GROUP BY event_type")
def latency_summary(spark, sf):
    return T.summarize(V.ev(spark, sf), ["event_type"], "value")


@query("percentile_rules", "AG47 AG52", f"""
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, {r6('max(CASE WHEN i = ceil(round(0.95 * n, 9)) - 1 THEN value END)')} AS nearest, {r6('max(CASE WHEN i = round_even(0.95 * (n - 1), 0) THEN value END)')} AS half_even, {r6('max(CASE WHEN i = floor(round(0.95 * n, 9)) THEN value END)')} AS floored,
 {r6('quantile_cont(value, 0.95)')} AS linear, {r6('max(CASE WHEN i = floor(round(0.95 * (n - 1), 9)) THEN value END)')} AS floor_last, {r6('max(CASE WHEN i = n // 2 THEN value END)')} AS upper_median, {r6('median(value)')} AS middle FROM s GROUP BY event_type""")
def percentile_rules(spark, sf):
    return Q.quantiles(V.ev(spark, sf), ["event_type"], "value", {
        "nearest": ("nearest", 0.95), "half_even": ("round", 0.95), "floored": ("floor", 0.95), "linear": ("linear", 0.95), "floor_last": ("floor_last", 0.95),
        "upper_median": ("upper_median", 0.5), "middle": ("middle", 0.5),
    })


SQL_VIEWS["gaps"] = "SELECT user_id, tick, us, (us - lag(us) OVER (PARTITION BY user_id ORDER BY tick)) / 1000.0 AS v FROM series"


@query("tick_jitter", "AG52", f"""
WITH s AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM gaps WHERE v IS NOT NULL), m AS (SELECT user_id, count(*) AS n_rows, max(us) - min(us) AS span FROM series GROUP BY user_id)
SELECT s.user_id, {r6('max(CASE WHEN i = least(floor(round(0.95 * n, 9)), n - 1) THEN v END)')} AS p95_ms, {r6('max(v)')} AS max_ms, count(*) FILTER (WHERE v > 43200000) AS n_over, any_value(n_rows) AS n_rows, {r6('any_value(span) / 1e6 - (any_value(n_rows) - 1) * 43200')} AS drift_s FROM s JOIN m USING (user_id) GROUP BY s.user_id""")
def tick_jitter(spark, sf):
    rows = T.intervals_ms(V.series(spark, sf), ["user_id"], ["tick"], S.tick_chunk("tick"), "us")
    per = rows.groupBy("user_id").agg(
        F.max("dt_ms").alias("max_ms"), F.count_if(F.col("dt_ms") > 43200000).alias("n_over"), F.count(F.lit(1)).alias("n_rows"),
        ((F.max("us") - F.min("us")) / 1e6 - (F.count(F.lit(1)) - 1) * 43200).alias("drift_s"),
    )
    return per.join(Q.quantiles(rows, ["user_id"], "dt_ms", {"p95_ms": ("floor", 0.95)}), "user_id")


@query("tick_health", "AG52", f"WITH x AS (SELECT * FROM gaps WHERE v IS NOT NULL) SELECT count(*) AS n, count(*) FILTER (WHERE v > 45360000) AS overruns, count(*) FILTER (WHERE v > 64800000) AS big_gaps, {r6('median(v)')} AS p50, {r6('quantile_disc(v, 0.99)')} AS p99 FROM x")
def tick_health(spark, sf):
    rows = cut_lineage(T.intervals_ms(V.series(spark, sf), ["user_id"], ["tick"], S.tick_chunk("tick"), "us").where("dt_ms is not null").select("dt_ms"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dt_ms") > 45360000).alias("overruns"), F.count_if(F.col("dt_ms") > 64800000).alias("big_gaps"))
    return counts.join(Q.quantiles(rows, [], "dt_ms", {"p50": ("middle", 0.5), "p99": ("nearest", 0.99)}))


def flow_log(spark, sf):
    """Command-flow log lines, one per event; a command is five events of one device."""
    s = V.series(spark, sf)
    stage = F.element_at(F.array(*[F.lit(x) for x in ("CLICK", "RECEIVE", "EXECUTE_DONE", "STATE_DETECTED", "STATE_PUSHED", "STATE_OK")]), (F.col("tick") % 6 + 1).cast("int"))
    stage = F.when((F.col("tick") % 6 == 5) & (F.col("k") % 9 == 0), "STATE_TIMEOUT").when(F.col("k") % 17 == 0, "NOTHING").otherwise(stage)
    observed = F.col("tick") % 6 > 2
    cid = F.when(observed & (F.col("tick") % 6 < 5), "-").otherwise(F.concat_ws("-", F.lit("c"), "user_id", F.floor(F.col("tick") / 6).cast("string")))
    subject = F.when(F.col("user_id") % 2 == 0, "disableLink").otherwise("enableLink")
    detail = F.when(F.col("k") % 5 == 0, "up").otherwise("down")
    stamp = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    line = F.concat(
        F.lit("["), stamp, F.lit("] [agent] [INFO] [cid="), cid, F.lit("] "), stage, F.when(observed, "").otherwise(F.concat(F.lit(" subject="), subject)),
        F.lit(" target=host:h"), F.col("user_id").cast("string"), F.when(observed, F.concat(F.lit(" detail="), detail)).otherwise(""), F.lit(" waitMs="), F.col("k").cast("string"),
    )
    path = fresh_path(spark, "flow")
    s.select(line.alias("value")).write.text(path)
    return L.read_flow_log(spark, path)


SQL_VIEWS["flog"] = """SELECT us, CASE WHEN k % 17 = 0 AND NOT (tick % 6 = 5 AND k % 9 = 0) THEN NULL WHEN tick % 6 = 5 AND k % 9 = 0 THEN 'ui_timeout' ELSE ['click', 'agent_receive', 'exec_done', 'detect', 'push', 'ui'][tick % 6 + 1] END AS stage,
  'host:h' || user_id AS target, CASE WHEN tick % 6 IN (3, 4) THEN '-' ELSE 'c-' || user_id || '-' || tick // 6 END AS cid, CASE WHEN tick % 6 <= 2 THEN CASE WHEN user_id % 2 = 0 THEN 'disableLink' ELSE 'enableLink' END END AS subject,
  CASE WHEN tick % 6 > 2 THEN CASE WHEN k % 5 = 0 THEN 'up' ELSE 'down' END END AS detail, CAST(k AS DOUBLE) AS wait_ms FROM series"""


@query("flow_log_events", "SRC9 FN13", f"""
SELECT us, stage, target, cid, subject, detail, {r6('wait_ms')} AS wait_ms, CASE WHEN subject = 'disableLink' THEN 'down' WHEN subject = 'enableLink' THEN 'up' END AS expect FROM flog WHERE stage IS NOT NULL""")
def flow_log_events(spark, sf):
    return flow_log(spark, sf)


SQL_VIEWS["cmds"] = """SELECT cid, any_value(target) AS target, arg_max(subject, us) FILTER (WHERE subject IS NOT NULL) AS subject, CASE arg_max(subject, us) FILTER (WHERE subject IS NOT NULL) WHEN 'disableLink' THEN 'down' WHEN 'enableLink' THEN 'up' END AS expect, min(us) AS first_us,
  min(us) FILTER (WHERE stage = 'click') AS click, min(us) FILTER (WHERE stage = 'agent_receive') AS agent_receive, min(us) FILTER (WHERE stage = 'exec_done') AS exec_done, min(us) FILTER (WHERE stage = 'ui') AS ui, min(us) FILTER (WHERE stage = 'ui_timeout') AS ui_timeout
  FROM flog WHERE stage IS NOT NULL AND cid <> '-' GROUP BY cid"""
SQL_VIEWS["cobs"] = """SELECT cid, min(us) FILTER (WHERE stage = 'detect') AS detect, min(us) FILTER (WHERE stage = 'push') AS push FROM (SELECT f.us, f.stage, c.cid, row_number() OVER (PARTITION BY f.target, f.stage, f.us ORDER BY c.first_us DESC) AS r FROM flog f JOIN cmds c ON c.target = f.target
  WHERE f.stage IN ('detect', 'push') AND c.exec_done IS NOT NULL AND f.us - c.exec_done BETWEEN 0 AND 259200000000 AND (coalesce(c.ui, c.ui_timeout) IS NULL OR f.us <= coalesce(c.ui, c.ui_timeout)) AND (c.expect IS NULL OR f.detail = c.expect)) WHERE r = 1 GROUP BY cid"""


@query("command_latency", "JN13 AG48", """
SELECT cid, target, subject, CAST(round((agent_receive - click) / 1000.0) AS BIGINT) AS route_ms, CAST(round((exec_done - agent_receive) / 1000.0) AS BIGINT) AS exec_ms, CAST(round((detect - exec_done) / 1000.0) AS BIGINT) AS detect_ms, CAST(round((push - detect) / 1000.0) AS BIGINT) AS push_ms,
 CAST(round((coalesce(ui_timeout, ui) - coalesce(click, exec_done)) / 1000.0) AS BIGINT) AS total_ms,
 CASE WHEN ui_timeout IS NOT NULL THEN 'TIMEOUT' WHEN agent_receive IS NULL THEN 'missing AGENT RECEIVE' WHEN exec_done IS NULL THEN 'missing EXECUTE_DONE' WHEN detect IS NULL THEN 'missing STATE_DETECTED' WHEN push IS NULL THEN 'missing STATE_PUSHED' WHEN ui IS NULL THEN 'missing UI reflection' ELSE '' END AS note
FROM cmds LEFT JOIN cobs USING (cid)""")
def command_latency(spark, sf):
    events = cut_lineage(flow_log(spark, sf))
    commands = T.command_stages(events)
    return T.command_figures(T.attach_observed(commands, events.where("stage in ('detect', 'push')"), 259200000000))


# Trials: each urgent order of a customer is a command; the customer's device runs the timeline.
SQL_VIEWS["trials"] = "SELECT user_id, tick AS trial, us + k * 36000000 AS ta, us + k * 36000000 + 3600000000 AS tb, k % 10 = 0 AS warmup FROM series WHERE event_type = 'signup'"
SQL_VIEWS["tline"] = "SELECT user_id, us AS t_in, us + k * 10000 AS t1, us + k * 20000 + 500000 AS t2, tick AS seq, CASE WHEN value > 100 THEN 'act' WHEN value > 60 THEN 'suspect' ELSE 'normal' END AS published, value > 50 AS observed, k % 4 <> 0 AS ok FROM series"
SQL_VIEWS["parts"] = """SELECT t.user_id, t.trial, t.warmup, t.ta, t.tb,
  (SELECT max(t_in) FROM tline l WHERE l.user_id = t.user_id AND t_in <= ta) AS prev_in, (SELECT min(t_in) FROM tline l WHERE l.user_id = t.user_id AND t_in > tb) AS next_in, (SELECT min(t_in) FROM tline l WHERE l.user_id = t.user_id AND t_in > tb AND observed) AS t_obs,
  (SELECT min(seq) FROM tline l WHERE l.user_id = t.user_id AND t_in > tb AND published <> 'normal') AS seq_alarm FROM trials t"""
SQL_VIEWS["decomp"] = """SELECT p.*, a.t1, a.t2, (SELECT min(seq) FROM tline l WHERE l.user_id = p.user_id AND seq >= seq_alarm AND ok AND published <> 'normal') AS seq_written FROM parts p LEFT JOIN tline a ON a.user_id = p.user_id AND a.seq = p.seq_alarm"""


def decomposed(spark, sf):
    s = V.series(spark, sf)
    trials = s.where("event_type = 'signup'").select("user_id", F.col("tick").alias("trial"), (F.col("us") + F.col("k") * 36000000).alias("ta"), (F.col("us") + F.col("k") * 36000000 + 3600000000).alias("tb"), (F.col("k") % 10 == 0).alias("warmup"))
    line = cut_lineage(s.select(
        "user_id", F.col("us").alias("t_in"), (F.col("us") + F.col("k") * 10000).alias("t1"), (F.col("us") + F.col("k") * 20000 + 500000).alias("t2"), F.col("tick").alias("seq"),
        F.when(F.col("value") > 100, "act").when(F.col("value") > 60, "suspect").otherwise("normal").alias("published"), (F.col("value") > 50).alias("observed"), (F.col("k") % 4 != 0).alias("ok"),
    ))

    def nearest(left, right, at, columns, name, forward):
        keyed = right.withColumnRenamed("t_in", at)
        return M.as_of(left, keyed, ["user_id"], at, columns, forward=forward).withColumnRenamed("_hit", name)

    alarm = line.where("published <> 'normal'")
    after = trials.withColumn("tb1", F.col("tb") + 1)
    out = nearest(after, line.select("user_id", "t_in"), "ta", [], "prev", False)
    out = nearest(out, line.select("user_id", "t_in"), "tb1", [], "next", True)
    out = nearest(out, line.where("observed").select("user_id", "t_in"), "tb1", [], "obs", True)
    out = cut_lineage(nearest(out, alarm.select("user_id", "t_in", "t1", "t2", "seq"), "tb1", ["seq", "t1", "t2"], "alarm", True))
    out = out.select("*", F.col("alarm.seq").alias("seq_alarm"))
    writes = alarm.where("ok").select("user_id", F.col("seq").alias("seq_alarm"))
    out = M.as_of(out, writes, ["user_id"], "seq_alarm", [], S.TICKS_PER_CHUNK, True).withColumn("seq_written", F.col("_hit.at"))
    return out.select(
        "user_id", "trial", "warmup", "ta", "tb", F.col("prev.at").alias("prev_in"), F.col("next.at").alias("next_in"), F.col("obs.at").alias("t_obs"), "seq_alarm",
        F.col("alarm.t1").alias("t1"), F.col("alarm.t2").alias("t2"), "seq_written",
    )


@query("trial_decomposition", "JN14", f"""
SELECT user_id, trial, warmup, seq_alarm IS NOT NULL AS detected, {r6('(ta - prev_in) / 1e6')} AS inject_offset_s, {r6('CASE WHEN next_in > prev_in THEN (ta - prev_in) / (next_in - prev_in) END')} AS inject_phase, seq_alarm, seq_written, coalesce(seq_written > seq_alarm, false) AS conflated,
 {r6('(t_obs - tb) / 1000.0')} AS phys_obs_ms, {r6('(t1 - t_obs) / 1000.0')} AS detect_ms, {r6('(t2 - t1) / 1000.0')} AS mailbox_ms, {r6('(t1 - ta) / 1000.0')} AS s4_ms FROM decomp""")
def trial_decomposition(spark, sf):
    d = decomposed(spark, sf)
    c = F.col
    return d.select(
        "user_id", "trial", "warmup", c("seq_alarm").isNotNull().alias("detected"), ((c("ta") - c("prev_in")) / 1e6).alias("inject_offset_s"),
        F.when(c("next_in") > c("prev_in"), (c("ta") - c("prev_in")) / (c("next_in") - c("prev_in"))).alias("inject_phase"), "seq_alarm", "seq_written",
        F.coalesce(c("seq_written") > c("seq_alarm"), F.lit(False)).alias("conflated"), ((c("t_obs") - c("tb")) / 1000.0).alias("phys_obs_ms"),
        ((c("t1") - c("t_obs")) / 1000.0).alias("detect_ms"), ((c("t2") - c("t1")) / 1000.0).alias("mailbox_ms"), ((c("t1") - c("ta")) / 1000.0).alias("s4_ms"),
    )


@query("latency_budget", "AG49", f"""
WITH u AS (SELECT unnest(['phys_obs', 'detect', 'mailbox', 's4_like']) AS layer, unnest([(t_obs - tb) / 1000.0, (t1 - t_obs) / 1000.0, (t2 - t1) / 1000.0, (t1 - ta) / 1000.0]) AS v FROM decomp WHERE NOT warmup AND seq_alarm IS NOT NULL)
SELECT layer, {SUMMARY}, quantile_disc(v, 0.95) <= 300000000 AS met FROM u GROUP BY layer""")
def latency_budget(spark, sf):
    d = decomposed(spark, sf).where("not warmup and seq_alarm is not null")
    ms = lambda a, b: (F.col(b) - F.col(a)) / 1000.0
    layers = [("phys_obs", "tb", "t_obs"), ("detect", "t_obs", "t1"), ("mailbox", "t1", "t2"), ("s4_like", "ta", "t1")]
    rows = d.select(F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), ms(a, b).alias("v")) for n, a, b in layers])).alias("_x")).select("_x.layer", "_x.v")
    return T.summarize(cut_lineage(rows), ["layer"], "v").withColumn("met", F.col("p95") <= 300000000)


@query("phase_quartiles", "AG49", """
SELECT CAST(least(floor(p * 4), 3) AS BIGINT) AS quartile, count(*) AS n FROM (SELECT ((ta - prev_in) % 3600000000) / 3600000000.0 AS p FROM decomp WHERE NOT warmup) GROUP BY 1""")
def phase_quartiles(spark, sf):
    share = ((F.col("ta") - F.col("prev_in")) % 3600000000) / 3600000000.0
    return decomposed(spark, sf).where("not warmup").groupBy(F.least(F.floor(share * 4), F.lit(3)).alias("quartile")).agg(F.count(F.lit(1)).alias("n"))


@query("window_category_counts", "AG50", """
WITH d AS (SELECT user_id, us, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY tick) AS p FROM series)
SELECT user_id, count(*) AS ticks, count(*) FILTER (WHERE event_type = 'click' AND p IS NOT NULL AND p <> 'click') AS act_entries, count(*) FILTER (WHERE event_type IN ('click', 'purchase') AND p IS NOT NULL AND p NOT IN ('click', 'purchase')) AS alarm_entries, count(*) FILTER (WHERE event_type = 'error') AS n_unknown
FROM d WHERE us >= 1704499200000000 AND us < 1705795200000000 GROUP BY user_id""")
def window_category_counts(spark, sf):
    told = S.scan(V.series(spark, sf), ["user_id"], ["tick"], S.tick_chunk("tick"), p=S.previous(F.col("event_type")))
    rows = told.where("us >= 1704499200000000 and us < 1705795200000000")
    now, p = F.col("event_type"), F.col("p")
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("ticks"), F.count_if((now == "click") & (p != "click")).alias("act_entries"),
        F.count_if(now.isin("click", "purchase") & ~p.isin("click", "purchase")).alias("alarm_entries"), F.count_if(now == "error").alias("n_unknown"),
    )


@query("memory_slope", "AG51", f"""
WITH s AS (SELECT user_id, tick, (us - {V.T0_US}) / 3600e6 AS h, value, count(*) OVER (PARTITION BY user_id) AS n FROM series)
SELECT user_id, any_value(n) AS n, {r6('CASE WHEN any_value(n) >= 4 THEN regr_slope(value, h) FILTER (WHERE tick >= n // 2) END')} AS slope, {r6('CASE WHEN any_value(n) >= 4 THEN arg_max(value, tick) - arg_min(value, tick) END')} AS delta, {r6('CASE WHEN any_value(n) >= 4 THEN max(value) END')} AS peak FROM s GROUP BY user_id""")
def memory_slope(spark, sf):
    rows = V.series(spark, sf).select("user_id", "tick", ((F.col("us") - V.T0_US) / 3600e6).alias("h"), "value")
    return T.second_half_slope(rows, ["user_id"], "tick", "h", "value")


SQL_VIEWS["spans"] = "SELECT user_id, us AS lo, us + 43200000000 AS hi FROM ev WHERE k % 10 = 5"
SQL_VIEWS["inout"] = "SELECT e.user_id, e.value, e.k % 8 <> 0 AS valid, EXISTS (SELECT 1 FROM spans s WHERE s.user_id = e.user_id AND s.lo <= e.us AND e.us < s.hi) AS inside FROM ev e"


@query("degraded_fraction", "AG53", f"""
WITH b AS (SELECT user_id, median(value) AS base FROM inout WHERE valid AND NOT inside GROUP BY user_id), i AS (SELECT user_id, count(*) FILTER (WHERE inside AND valid) AS n_valid, count(*) FILTER (WHERE inside AND NOT valid) AS n_invalid FROM inout GROUP BY user_id)
SELECT i.user_id, {r6('base')} AS baseline, n_valid, n_invalid, {r6('(SELECT avg(CASE WHEN value < base * 0.5 THEN 1.0 ELSE 0.0 END) FROM inout x WHERE x.user_id = i.user_id AND inside AND valid)')} AS fraction FROM i LEFT JOIN b USING (user_id)""")
def degraded_fraction(spark, sf):
    rows = V.ev(spark, sf)
    spans = rows.where("k % 10 = 5").select("user_id", F.col("us").alias("lo"), (F.col("us") + 43200000000).alias("hi"))
    held = cut_lineage(I.active_counts(rows.select("user_id", "us", "value", (F.col("k") % 8 != 0).alias("valid")), spans, ["user_id"], "us", "lo", "hi"))
    base = Q.quantiles(held.where("valid and n_active = 0"), ["user_id"], "value", {"baseline": ("middle", 0.5)})
    inside = F.col("n_active") > 0
    per = held.join(base, "user_id", "left").groupBy("user_id", "baseline").agg(
        F.count_if(inside & F.col("valid")).alias("n_valid"), F.count_if(inside & ~F.col("valid")).alias("n_invalid"),
        F.avg(F.when(inside & F.col("valid"), (F.col("value") < F.col("baseline") * 0.5).cast("double"))).alias("fraction"),
    )
    return per.select("user_id", "baseline", "n_valid", "n_invalid", F.when(F.col("baseline").isNotNull(), F.col("fraction")).alias("fraction"))


@query("sampler_window", "AG54", f"SELECT user_id, {r6('avg(value) FILTER (WHERE k % 8 <> 0)')} AS mean, count(*) FILTER (WHERE k % 8 <> 0) AS n_valid, count(*) FILTER (WHERE k % 8 = 0) AS n_invalid FROM ev WHERE us >= 1704499200000000 AND us < 1705363200000000 GROUP BY user_id")
def sampler_window(spark, sf):
    valid = F.col("k") % 8 != 0
    return V.ev(spark, sf).where("us >= 1704499200000000 and us < 1705363200000000").groupBy("user_id").agg(
        F.avg(F.when(valid, F.col("value"))).alias("mean"), F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_invalid")
    )


SQL_VIEWS["abtrials"] = "SELECT user_id AS block, CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END AS arm, CASE WHEN k % 12 <> 0 THEN value END AS v FROM ev"
SQL_VIEWS["abdiff"] = "SELECT block, avg(v) FILTER (WHERE arm = 'A') - avg(v) FILTER (WHERE arm = 'B') AS diff FROM abtrials GROUP BY block HAVING count(v) FILTER (WHERE arm = 'A') > 0 AND count(v) FILTER (WHERE arm = 'B') > 0"


def ab_trials(spark, sf):
    return V.ev(spark, sf).select(F.col("user_id").alias("block"), F.when(F.col("k") % 2 == 0, "A").otherwise("B").alias("arm"), F.when(F.col("k") % 12 != 0, F.col("value")).alias("v"))


@query("block_differences", "AG55", f"SELECT block, {r6('diff')} AS diff FROM abdiff")
def block_differences(spark, sf):
    from gaugeline.operators.resampling import block_diffs

    return block_diffs(ab_trials(spark, sf), "block", "arm", "v")


@query("arm_means", "AG55", f"""
SELECT arm, {r6('avg(v)')} AS mean, {r6('stddev_samp(v)')} AS sd, count(v) AS n, {r6('min(v)')} AS low, {r6('max(v)')} AS high, stddev_samp(v) / greatest(abs(avg(v)), 1e-9) < 0.005 AS ceiling_warning FROM abtrials WHERE v IS NOT NULL GROUP BY arm""")
def arm_means(spark, sf):
    sd = F.coalesce(F.stddev_samp("v"), F.lit(0.0))
    return ab_trials(spark, sf).where("v is not null").groupBy("arm").agg(
        F.avg("v").alias("mean"), sd.alias("sd"), F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"),
        (sd / F.greatest(F.abs(F.avg("v")), F.lit(1e-9)) < 0.005).alias("ceiling_warning"),
    )


SQL_VIEWS["trec"] = "SELECT event_type AS scenario, event_id, CASE WHEN k % 7 = 0 THEN 'INVALID' WHEN k % 5 = 0 THEN 'FAIL' ELSE 'PASS' END AS outcome, value FROM ev"


@query("scenario_table", "AG56 SRT4", f"""
WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY event_id) AS r FROM trec WHERE outcome <> 'INVALID') WHERE r <= 5), x AS (SELECT scenario, count(*) AS n_invalid FROM trec WHERE outcome = 'INVALID' GROUP BY scenario)
SELECT scenario, count(*) AS n_counted, count(*) FILTER (WHERE outcome = 'PASS') AS n_pass, any_value(n_invalid) AS n_invalid, {r6("median(value) FILTER (WHERE outcome = 'PASS')")} AS seg_median, {r6("min(value) FILTER (WHERE outcome = 'PASS')")} AS seg_min, {r6("max(value) FILTER (WHERE outcome = 'PASS')")} AS seg_max,
 coalesce(string_agg(CASE WHEN outcome = 'FAIL' THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY event_id), '') AS failed FROM f LEFT JOIN x USING (scenario) GROUP BY scenario""")
def scenario_table(spark, sf):
    outcome = F.when(F.col("k") % 7 == 0, "INVALID").when(F.col("k") % 5 == 0, "FAIL").otherwise("PASS")
    rows = V.ev(spark, sf).select(F.col("event_type").alias("scenario"), "event_id", outcome.alias("outcome"), "value")
    invalid = rows.where("outcome = 'INVALID'").groupBy("scenario").agg(F.count(F.lit(1)).alias("n_invalid"))
    first = R.top_per_key(rows.where("outcome <> 'INVALID'"), ["scenario"], "event_id", ["event_id"], 5, ascending=True)
    passed = F.col("outcome") == "PASS"
    seg = F.when(passed, F.col("value"))
    fails = F.array_sort(F.collect_list(F.when(F.col("outcome") == "FAIL", F.col("event_id"))))
    per = first.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_counted"), F.count_if(passed).alias("n_pass"), F.percentile(seg, 0.5).alias("seg_median"), F.min(seg).alias("seg_min"), F.max(seg).alias("seg_max"),
        F.array_join(F.transform(fails, lambda x: x.cast("string")), ",").alias("failed"),
    )
    return per.join(invalid, "scenario", "left")


SQL_VIEWS["scal"] = "SELECT user_id, max(us) FILTER (WHERE k = 50 OR tick = 5) AS t0 FROM series GROUP BY user_id"


# A purchase is an intent; every fourth is not applied, the others k seconds later. Two instances are wanted while k >= 48.
SQL_VIEWS["scalx"] = """WITH o AS (SELECT c.user_id, t0, min(us) FILTER (WHERE us >= t0 AND value > 80) AS onset FROM scal c JOIN series s USING (user_id) GROUP BY ALL),
d AS (SELECT o.*, (SELECT arg_min({'d': us, 'a': us + k * 1000000}, us) FROM series s WHERE s.user_id = o.user_id AND us >= t0 AND event_type = 'purchase' AND k % 4 <> 0) AS p FROM o),
i AS (SELECT d.*, p.d AS decided, p.a AS applied, (SELECT min(us) FROM series s WHERE s.user_id = d.user_id AND us >= p.a AND event_type IN ('view', 'signup')) AS serving,
  (SELECT min(us) FROM series s WHERE s.user_id = d.user_id AND us >= p.a AND event_type = 'view') AS healthy FROM d)
SELECT i.*, (SELECT count(*) FROM series s WHERE s.user_id = i.user_id AND us >= t0 AND event_type = 'purchase' AND k % 4 <> 0 AND (healthy IS NULL OR us <= healthy)) AS n_applied,
  (SELECT max(CASE WHEN k >= 48 THEN 2 ELSE 1 END) FROM series s WHERE s.user_id = i.user_id AND us >= t0 AND (healthy IS NULL OR us <= healthy)) AS desired FROM i"""


@query("scaling_segments", "AG57", f"""
SELECT user_id, {r6('(onset - t0) / 1e6')} AS to_onset_s, {r6('(decided - onset) / 1e6')} AS to_decision_s, {r6('(applied - decided) / 1e6')} AS to_applied_s, {r6('(serving - applied) / 1e6')} AS to_serving_s,
 {r6('(healthy - serving) / 1e6')} AS to_healthy_s, {r6('(healthy - onset) / 1e6')} AS total_s, n_applied, desired AS max_desired,
 CASE WHEN onset IS NULL THEN 'FAIL no onset' WHEN healthy IS NULL THEN 'FAIL not healthy' WHEN n_applied <> 1 THEN 'FAIL not one action' WHEN desired > 1 THEN 'FAIL desired above one' ELSE 'PASS' END AS outcome FROM scalx""")
def scaling_segments(spark, sf):
    s = cut_lineage(V.series(spark, sf).select("user_id", "tick", "k", "value", "event_type", F.col("us").alias("t")))
    trials = s.groupBy("user_id").agg(F.max(F.when((F.col("k") == 50) | (F.col("tick") == 5), F.col("t"))).alias("t0"))
    trials = P.first_time(s, trials, ["user_id"], F.col("value") > 80, "t0", "onset")
    intents = s.where("event_type = 'purchase' and k % 4 <> 0").select("user_id", F.col("t").alias("d"), (F.col("t") + F.col("k") * 1000000).alias("a"))
    first = intents.join(trials.select("user_id", "t0"), "user_id").where("d >= t0").groupBy("user_id").agg(F.min("d").alias("decided"), F.min_by("a", "d").alias("applied"))
    trials = cut_lineage(trials.join(first, "user_id", "left"))
    for test, name in ((F.col("event_type").isin("view", "signup"), "serving"), (F.col("event_type") == "view", "healthy")):
        trials = P.first_time(s, trials, ["user_id"], test, "applied", name)
    trials = cut_lineage(trials)
    open_ = lambda at: (F.col(at) >= F.col("t0")) & (F.col("healthy").isNull() | (F.col(at) <= F.col("healthy")))
    ends = trials.select("user_id", "t0", "healthy")
    acts = intents.join(ends, "user_id").where(open_("d")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_applied"))
    wanted = s.join(ends, "user_id").where(open_("t")).groupBy("user_id").agg(F.max(F.when(F.col("k") >= 48, 2).otherwise(1)).alias("max_desired"))
    out = trials.join(acts, "user_id", "left").join(wanted, "user_id", "left").withColumn("n_applied", F.coalesce("n_applied", F.lit(0)))
    sec = lambda a, b: (F.col(b) - F.col(a)) / 1e6
    outcome = (
        F.when(F.col("onset").isNull(), "FAIL no onset").when(F.col("healthy").isNull(), "FAIL not healthy").when(F.col("n_applied") != 1, "FAIL not one action")
        .when(F.col("max_desired") > 1, "FAIL desired above one").otherwise("PASS")
    )
    return out.select(
        "user_id", sec("t0", "onset").alias("to_onset_s"), sec("onset", "decided").alias("to_decision_s"), sec("decided", "applied").alias("to_applied_s"), sec("applied", "serving").alias("to_serving_s"),
        sec("serving", "healthy").alias("to_healthy_s"), sec("onset", "healthy").alias("total_s"), "n_applied", "max_desired", outcome.alias("outcome"))


@query("age_of_information", "AG59", f"""
WITH a AS (SELECT event_type, (SELECT max(us) FROM ev) / 1e6 - (us / 1e6) - CASE WHEN k % 50 = 0 THEN 3000000.0 ELSE 0.0 END AS aoi FROM ev)
SELECT event_type, {r6('avg(aoi)')} AS mean, {r6('max(aoi)')} AS max, count(*) AS n, count(*) FILTER (WHERE aoi < -0.05) AS n_negative, {r6('least(greatest(quantile_cont(aoi, 0.95) FILTER (WHERE aoi >= -0.05) / 3000000.0, 0.0), 1.0)')} AS norm_p95 FROM a GROUP BY event_type""")
def age_of_information(spark, sf):
    rows = V.ev(spark, sf)
    now = F.broadcast(rows.agg(F.max("us").alias("now")))
    aged = cut_lineage(rows.join(now).select("event_type", (F.col("now") / 1e6 - F.col("us") / 1e6 - F.when(F.col("k") % 50 == 0, 3000000.0).otherwise(0.0)).alias("aoi")))
    per = aged.groupBy("event_type").agg(F.avg("aoi").alias("mean"), F.max("aoi").alias("max"), F.count("aoi").alias("n"), F.count_if(F.col("aoi") < -0.05).alias("n_negative"))
    p95 = Q.quantiles(aged.where("aoi >= -0.05"), ["event_type"], "aoi", {"p95": ("linear", 0.95)})
    return per.join(p95, "event_type", "left").withColumn("norm_p95", F.least(F.greatest(F.col("p95") / 3000000.0, F.lit(0.0)), F.lit(1.0))).drop("p95")


SQL_VIEWS["probe"] = """SELECT run_id, tick, CASE WHEN tick < 20 THEN 'pre' WHEN tick < 40 THEN 'fault' ELSE 'post' END AS phase, sum(CASE WHEN event_type IN ('click', 'view') THEN value ELSE 0 END) - sum(CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE 0 END) AS bal,
  count(*) FILTER (WHERE k % 10 = 0) AS drops, count(*) AS packets, sum(value) AS bytes FROM ev GROUP BY run_id, tick"""


@query("loss_accounting", "AG60", f"""
WITH p AS (SELECT run_id, avg(bal) AS bias, sum(bytes) / sum(packets) AS mpb FROM probe WHERE phase = 'pre' AND tick >= 2 GROUP BY run_id), n AS (SELECT q.run_id, max(abs(bal - bias)) AS noise FROM probe q JOIN p USING (run_id) WHERE phase = 'pre' AND tick >= 2 GROUP BY q.run_id),
w AS (SELECT q.run_id, sum(bal - bias) AS missing, count(*) AS n_ticks, CAST(sum(drops) AS BIGINT) AS drops, max(bal - bias) AS backlog FROM probe q JOIN p USING (run_id) WHERE phase = 'fault' GROUP BY q.run_id),
s AS (SELECT w.run_id, missing, noise, n_ticks, drops, CASE WHEN missing > 0 THEN drops * mpb / missing END AS leaf, CASE WHEN missing > 0 THEN backlog / missing END AS queue FROM w JOIN p USING (run_id) JOIN n USING (run_id))
SELECT run_id, {r6('missing')} AS missing, {r6('noise')} AS noise, n_ticks, drops, {r6('leaf')} AS share_leaf, {r6('queue')} AS share_queue, {r6('leaf + queue')} AS closure,
 CASE WHEN missing <= 0.1 * noise * sqrt(n_ticks) THEN 'NO_MISSING' WHEN leaf + queue IS NULL OR abs(leaf + queue - 1) > 0.6 THEN 'UNEXPLAINED' WHEN leaf < 0.2 AND queue >= 0.8 THEN 'QUEUE_ONLY' WHEN leaf >= 0.8 THEN 'DROP_DOMINANT' WHEN leaf >= 0.2 AND queue >= 0.2 THEN 'QUEUE_THEN_DROP' ELSE 'UNEXPLAINED' END AS class FROM s""")
def loss_accounting(spark, sf):
    from gaugeline.operators.losses import account

    value = lambda *kinds: F.sum(F.when(F.col("event_type").isin(*kinds), F.col("value")).otherwise(0.0))
    rows = V.ev(spark, sf).groupBy("run_id", "tick").agg(
        (value("click", "view") - value("purchase", "signup")).alias("bal"), F.count_if(F.col("k") % 10 == 0).alias("drops"), F.count(F.lit(1)).alias("packets"), F.sum("value").alias("bytes")
    )
    phase = F.when(F.col("tick") < 20, "pre").when(F.col("tick") < 40, "fault").otherwise("post")
    return account(rows.withColumn("phase", phase), ["run_id"], noise_factor=0.1, closure_tolerance=0.6)


SQL_VIEWS["losscls"] = """SELECT r.run_id, r.profile, r.grp, w.missing > 0 AS hit FROM runs r JOIN (SELECT q.run_id, sum(bal - bias) AS missing FROM probe q JOIN (SELECT run_id, avg(bal) AS bias FROM probe WHERE phase = 'pre' AND tick >= 2 GROUP BY run_id) p USING (run_id) WHERE phase = 'fault' GROUP BY q.run_id) w USING (run_id)"""


@query("loss_conclusions", "AG60", """
SELECT profile, count(*) AS n_repeats, bool_and(hit) AS all_missing, bool_or(hit) AS any_missing, CASE WHEN count(*) < 2 THEN 'too_few' WHEN bool_and(hit) THEN 'confirmed' WHEN bool_or(hit) THEN 'mixed' ELSE 'refuted' END AS conclusion FROM losscls GROUP BY profile""")
def loss_conclusions(spark, sf):
    from gaugeline.operators.losses import account, conclude

    value = lambda *kinds: F.sum(F.when(F.col("event_type").isin(*kinds), F.col("value")).otherwise(0.0))
    rows = V.ev(spark, sf).groupBy("run_id", "tick").agg(
        (value("click", "view") - value("purchase", "signup")).alias("bal"), F.count_if(F.col("k") % 10 == 0).alias("drops"), F.count(F.lit(1)).alias("packets"), F.sum("value").alias("bytes")
    )
    phase = F.when(F.col("tick") < 20, "pre").when(F.col("tick") < 40, "fault").otherwise("post")
    probes = account(rows.withColumn("phase", phase), ["run_id"]).join(V.runs(spark, sf).select("run_id", "profile"), "run_id")
    return conclude(probes.withColumn("some", F.col("missing") > 0), ["profile"], "some")


@query("replacement_segments", "AG57", f"""
WITH t AS (SELECT user_id, us AS t0, k AS victim FROM series WHERE tick = 3),
d AS (SELECT t.*, (SELECT min(us) FROM series s WHERE s.user_id = t.user_id AND us >= t0 AND value < 20) AS t_drop FROM t),
n AS (SELECT d.*, (SELECT min(us) FROM series s WHERE s.user_id = d.user_id AND us >= t0 AND event_type = 'signup') AS t_new, (SELECT min(us) FROM series s WHERE s.user_id = d.user_id AND us >= t0 AND value >= 20 AND k <> victim AND event_type = 'view') AS t_back FROM d)
SELECT user_id, {r6('(t_drop - t0) / 1e6')} AS to_drop_s, {r6('(t_new - t0) / 1e6')} AS to_new_s, {r6('(t_back - t0) / 1e6')} AS to_restored_s, {r6('(t_back - t_drop) / 1e6')} AS degraded_s,
 CASE WHEN t_back IS NULL THEN 'FAIL not restored' WHEN (SELECT bool_or(k = 0) FROM series s WHERE s.user_id = n.user_id AND us >= t0 AND us <= t_back) THEN 'FAIL desired changed' ELSE 'PASS' END AS outcome FROM n""")
def replacement_segments(spark, sf):
    s = cut_lineage(V.series(spark, sf).select("user_id", "tick", "k", "value", "event_type", F.col("us").alias("t")))
    trials = s.where("tick = 3").select("user_id", F.col("t").alias("t0"), F.col("k").alias("victim"))
    seen = s.join(trials.select("user_id", "victim"), "user_id")
    back = (F.col("value") >= 20) & (F.col("k") != F.col("victim")) & (F.col("event_type") == "view")
    for test, name in ((F.col("value") < 20, "t_drop"), (F.col("event_type") == "signup", "t_new"), (back, "t_back")):
        trials = P.first_time(seen, trials, ["user_id"], test, "t0", name)
    moved = s.where("k = 0").join(trials.select("user_id", "t0", "t_back"), "user_id").where("t between t0 and t_back").select("user_id").distinct().withColumn("moved", F.lit(True))
    sec = lambda a, b: (F.col(b) - F.col(a)) / 1e6
    outcome = F.when(F.col("t_back").isNull(), "FAIL not restored").when(F.col("moved"), "FAIL desired changed").otherwise("PASS")
    return trials.join(moved, "user_id", "left").select(
        "user_id", sec("t0", "t_drop").alias("to_drop_s"), sec("t0", "t_new").alias("to_new_s"), sec("t0", "t_back").alias("to_restored_s"), sec("t_drop", "t_back").alias("degraded_s"), outcome.alias("outcome")
    )
