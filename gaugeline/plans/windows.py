"""Window operators: deltas, rolling means, counters, islands, intervals, chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import counters as C
from gaugeline.operators import intervals as I
from gaugeline.operators import scan as S
from gaugeline.plans import views as V
from gaugeline.plans.registry import query, r6

RUN = ["run_id", "entity"]
DAY_US = 86400 * 10**6


@query("tick_delta", "WIN1", f"""
WITH v AS (SELECT run_id, entity, tick, CASE WHEN ok THEN rate END AS rate FROM cells)
SELECT run_id, entity, tick, {r6('rate - lag(rate) OVER (PARTITION BY run_id, entity ORDER BY tick)')} AS delta FROM v""")
def tick_delta(spark, sf):
    return C.delta(V.valid_rates(spark, sf), RUN, ["tick"], S.tick_chunk("tick"), "rate").select(*RUN, "tick", "delta")


@query("rolling_past_mean", "WIN2", f"""
WITH v AS (SELECT run_id, entity, tick, CASE WHEN ok THEN rate END AS rate FROM cells)
SELECT run_id, entity, tick, {r6('CASE WHEN count(rate) OVER w = 3 THEN avg(rate) OVER w END')} AS mean3 FROM v
WINDOW w AS (PARTITION BY run_id, entity ORDER BY tick ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def rolling_past_mean(spark, sf):
    out = C.rolling_mean(V.valid_rates(spark, sf), RUN, ["tick"], S.tick_chunk("tick"), "rate", 3, "mean3")
    return out.select(*RUN, "tick", "mean3")


COUNTER_SQL = """WITH c AS (SELECT user_id, tick, us / 1e6 AS sec, k,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY tick) AS BIGINT) % 100000 AS bytes,
  CASE WHEN k % 7 = 0 THEN 0.0 ELSE value END AS reported,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY tick) AS BIGINT) AS full_count FROM series)"""


def counter_series(spark, sf):
    base = V.series(spark, sf)
    cents = F.round(F.col("value") * 100).cast("bigint")
    out = S.scan(base, ["user_id"], ["tick"], S.tick_chunk("tick"), full_count=S.total(cents))
    return out.select(
        "user_id", "tick", "us", (F.col("us") / 1e6).alias("sec"), "k", "full_count", (F.col("full_count") % 100000).alias("bytes"),
        F.when(F.col("k") % 7 == 0, 0.0).otherwise(F.col("value")).alias("reported"),
    )


@query("counter_rates", "WIN3", COUNTER_SQL + f""",
p AS (SELECT *, lag(bytes) OVER w AS pb, lag(sec) OVER w AS ps FROM c WINDOW w AS (PARTITION BY user_id ORDER BY tick))
SELECT user_id, tick, {r6('CASE WHEN pb IS NULL OR sec - ps <= 0 OR bytes < pb THEN 0.0 ELSE (bytes - pb) / (sec - ps) END')} AS bytes_rate,
 CASE WHEN pb IS NULL THEN 'warmup' WHEN sec - ps <= 0 THEN 'nonpositive_dt' WHEN bytes < pb THEN 'counter_reset' ELSE 'ok' END AS rate_reason FROM p""")
def counter_rates(spark, sf):
    out = C.counter_rates(counter_series(spark, sf), ["user_id"], ["tick"], S.tick_chunk("tick"), ["bytes"], "sec")
    return out.select("user_id", "tick", "bytes_rate", "rate_reason")


@query("fabricated_zero_audit", "WIN5 SRT5", COUNTER_SQL + """,
p AS (SELECT *, lag(full_count) OVER (PARTITION BY user_id ORDER BY tick) AS pc FROM c)
SELECT user_id, tick, CASE WHEN pc IS NULL THEN 'warmup_no_prev' ELSE 'zero_but_counter_advanced' END AS kind, full_count - pc AS counter_delta
FROM p WHERE reported = 0 AND (pc IS NULL OR full_count > pc) ORDER BY user_id, tick LIMIT 40""")
def fabricated_zero_audit(spark, sf):
    found = C.fabricated_zeros(counter_series(spark, sf), ["user_id"], ["tick"], S.tick_chunk("tick"), "full_count", "reported")
    return found.select("user_id", "tick", "kind", "counter_delta").orderBy("user_id", "tick").limit(40)


@query("fabricated_zero_counts", "WIN5", COUNTER_SQL + """,
p AS (SELECT *, lag(full_count) OVER (PARTITION BY user_id ORDER BY tick) AS pc FROM c)
SELECT CASE WHEN pc IS NULL THEN 'warmup_no_prev' ELSE 'zero_but_counter_advanced' END AS kind, count(*) AS n
FROM p WHERE reported = 0 AND (pc IS NULL OR full_count > pc) GROUP BY 1""")
def fabricated_zero_counts(spark, sf):
    found = C.fabricated_zeros(counter_series(spark, sf), ["user_id"], ["tick"], S.tick_chunk("tick"), "full_count", "reported")
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("queue_interval_loss", "WIN4", f"""
WITH s AS (SELECT run_id, entity, tick, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS side, count(*) FILTER (WHERE k % 10 = 0) AS d, count(*) AS p, max(k) % 17 = 0 AS odd, min(k) % 29 = 0 AS dead FROM ev GROUP BY ALL),
q AS (SELECT run_id, entity, tick, side, dead, odd, CAST(sum(d) OVER w AS BIGINT) % 40 AS drops, CAST(sum(p) OVER w AS BIGINT) AS packets FROM s WINDOW w AS (PARTITION BY run_id, entity, side ORDER BY tick)),
t AS (SELECT run_id, entity, tick, count(*) AS n, string_agg(side, ',' ORDER BY side) AS names, bool_or(dead) AS dead,
  max(drops) FILTER (WHERE side = 'a') AS ad, max(packets) FILTER (WHERE side = 'a') AS ap, bool_or(odd) FILTER (WHERE side = 'a') AS ao,
  max(drops) FILTER (WHERE side = 'b') AS bd, max(packets) FILTER (WHERE side = 'b') AS bp, bool_or(odd) FILTER (WHERE side = 'b') AS bo FROM q GROUP BY ALL),
l AS (SELECT *, lag(names) OVER w AS pn, lag(dead) OVER w AS pdead, lag(ad) OVER w AS pad, lag(ap) OVER w AS pap, lag(ao) OVER w AS pao, lag(bd) OVER w AS pbd, lag(bp) OVER w AS pbp, lag(bo) OVER w AS pbo FROM t WINDOW w AS (PARTITION BY run_id, entity ORDER BY tick)),
r AS (SELECT *, CASE WHEN dead THEN 'unavailable' WHEN pn IS NULL OR pn <> names THEN 'warmup'
  WHEN pdead OR coalesce(ad < pad OR ap < pap OR ao <> pao, false) OR coalesce(bd < pbd OR bp < pbp OR bo <> pbo, false) THEN 'counter_reset' ELSE 'ok' END AS reason,
  coalesce(ad - pad, 0) + coalesce(bd - pbd, 0) AS dd, coalesce(ap - pap, 0) + coalesce(bp - pbp, 0) AS sd FROM l)
SELECT run_id, entity, tick, reason, CASE WHEN reason = 'ok' THEN dd END AS drop_delta, CASE WHEN reason = 'ok' THEN sd END AS sent_delta,
 {r6("CASE WHEN reason = 'ok' THEN CASE WHEN dd + sd > 0 THEN round(100.0 * dd / (dd + sd), 3) ELSE 0.0 END END")} AS loss_pct FROM r""")
def queue_interval_loss(spark, sf):
    side = F.when(F.col("user_id") % 2 == 0, "a").otherwise("b")
    base = V.ev(spark, sf).groupBy("run_id", "entity", "tick", side.alias("side")).agg(
        F.count_if(F.col("k") % 10 == 0).alias("d"), F.count(F.lit(1)).alias("p"),
        (F.max("k") % 17 == 0).alias("odd"), (F.min("k") % 29 == 0).alias("dead"),
    )
    counted = S.scan(base, [*RUN, "side"], ["tick"], S.tick_chunk("tick"), drops=S.total(F.col("d")), packets=S.total(F.col("p")))
    live = ~F.col("dead")
    queues = F.struct(
        F.col("side").alias("name"), F.col("odd").alias("sig"),
        F.when(live, F.col("drops") % 40).alias("drops"), F.when(live, F.col("packets")).alias("packets"),
    )
    ticks = counted.groupBy(*RUN, "tick").agg(F.array_sort(F.collect_list(queues)).alias("queues"))
    out = C.queue_interval(ticks, RUN, ["tick"], S.tick_chunk("tick"), "queues")
    return out.select(*RUN, "tick", "reason", "drop_delta", "sent_delta", "loss_pct")


@query("warmup_filter", "WIN6 PRJ6", "SELECT user_id, event_id, tick FROM series WHERE tick >= 2")
def warmup_filter(spark, sf):
    return V.series(spark, sf).where("tick >= 2").select("user_id", "event_id", "tick")


@query("alarm_clusters", "WIN8", """
WITH a AS (SELECT run_id, entity, tick, tick - row_number() OVER (PARTITION BY run_id, entity ORDER BY tick) AS g FROM cells WHERE rate > 200)
SELECT run_id, entity, count(DISTINCT g) AS n_clusters, count(*) AS n_ticks FROM a GROUP BY run_id, entity""")
def alarm_clusters(spark, sf):
    marked = S.islands(V.cells(spark, sf).where("rate > 200"), RUN, "tick")
    spans = marked.groupBy(*RUN, "island").agg(F.count(F.lit(1)).alias("n"))
    return spans.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n_ticks"))


@query("act_episodes", "WIN9 ST16", f"""
WITH a AS (SELECT run_id, entity, tick, rate, tick - row_number() OVER (PARTITION BY run_id, entity ORDER BY tick) AS g FROM cells WHERE rate > 200)
SELECT run_id, entity, min(tick) AS t_first, max(tick) AS t_last, count(*) AS n_ticks, {r6('arg_min(rate, tick)')} AS first_rate FROM a GROUP BY run_id, entity, g""")
def act_episodes(spark, sf):
    marked = S.islands(V.cells(spark, sf).where("rate > 200"), RUN, "tick")
    return marked.groupBy(*RUN, "island").agg(
        F.min("tick").alias("t_first"), F.max("tick").alias("t_last"), F.count(F.lit(1)).alias("n_ticks"),
        F.min_by("rate", "tick").alias("first_rate"),
    ).drop("island")


@query("value_segments", "WIN10", """
WITH v AS (SELECT run_id, entity, tick, CAST(floor(rate / 100) AS BIGINT) AS level FROM cells),
c AS (SELECT *, CASE WHEN level = lag(level) OVER w THEN 0 ELSE 1 END AS f FROM v WINDOW w AS (PARTITION BY run_id, entity ORDER BY tick)),
s AS (SELECT *, sum(f) OVER (PARTITION BY run_id, entity ORDER BY tick) AS seg FROM c),
g AS (SELECT run_id, entity, seg, any_value(level) AS level, min(tick) AS t_start, count(*) AS n_rows FROM s GROUP BY ALL)
SELECT run_id, entity, CAST(seg AS BIGINT) AS segment, level, t_start, n_rows,
  lead(t_start, 1, 60) OVER (PARTITION BY run_id, entity ORDER BY seg) - t_start AS length FROM g""")
def value_segments(spark, sf):
    base = V.cells(spark, sf).withColumn("level", F.floor(F.col("rate") / 100).cast("bigint"))
    cut = S.segments(base, RUN, ["tick"], S.tick_chunk("tick"), "level")
    spans = cut.groupBy(*RUN, "segment", "level").agg(F.min("tick").alias("t_start"), F.count(F.lit(1)).alias("n_rows"))
    out = S.scan(spans, RUN, ["segment"], S.tick_chunk("segment"), _n=S.following(F.col("t_start")))
    return out.withColumn("length", F.coalesce("_n", F.lit(60)) - F.col("t_start")).drop("_n")


@query("client_streaks", "WIN17", """
WITH h AS (SELECT run_id, entity, tick, rate, tick - row_number() OVER (PARTITION BY run_id, entity ORDER BY tick) AS g FROM cells WHERE ok AND rate > 150),
s AS (SELECT run_id, entity, tick, row_number() OVER (PARTITION BY run_id, entity, g ORDER BY tick) AS streak FROM h)
SELECT run_id, tick, count(*) AS n_hot, CASE WHEN count(*) = 1 THEN min(entity) END AS target FROM s WHERE streak >= 2 GROUP BY run_id, tick""")
def client_streaks(spark, sf):
    hot = S.islands(V.valid_rates(spark, sf).where("rate > 150"), RUN, "tick")
    first = F.min("tick").alias("t0")
    placed = hot.join(hot.groupBy(*RUN, "island").agg(first), [*RUN, "island"]).where("tick - t0 + 1 >= 2")
    return placed.groupBy("run_id", "tick").agg(
        F.count(F.lit(1)).alias("n_hot"), F.min("entity").alias("e")
    ).select("run_id", "tick", "n_hot", F.when(F.col("n_hot") == 1, F.col("e")).alias("target"))


@query("hash_chain_breaks", "WIN18 SRC8 FN9", """
WITH l AS (SELECT user_id, tick, k, concat_ws('|', tick, event_id, event_type, k) AS line FROM series),
c AS (SELECT user_id, tick, CASE WHEN tick = 0 THEN 'genesis' WHEN k % 40 = 13 THEN sha256('forged') ELSE sha256(lag(line) OVER w) END AS stored,
  coalesce(sha256(lag(line) OVER w), 'genesis') AS expected FROM l WINDOW w AS (PARTITION BY user_id ORDER BY tick))
SELECT user_id, count(*) AS n_rows, count(*) FILTER (WHERE stored <> expected) AS n_breaks, min(tick) FILTER (WHERE stored <> expected) AS first_break FROM c GROUP BY user_id""")
def hash_chain_breaks(spark, sf):
    base = V.series(spark, sf).withColumn("line", F.concat_ws("|", "tick", "event_id", "event_type", "k"))
    told = S.scan(base, ["user_id"], ["tick"], S.tick_chunk("tick"), p=S.previous(F.col("line")))
    stored = F.when(F.col("tick") == 0, "genesis").when(F.col("k") % 40 == 13, F.sha2(F.lit("forged"), 256)).otherwise(F.sha2("p", 256))
    log = told.select("user_id", "tick", "line", stored.alias("prev_hash"))
    from gaugeline.operators.chains import verify_chain

    return verify_chain(log, ["user_id"], "tick", "line", "prev_hash")


@query("steady_windows", "WIN19", """
WITH w AS (SELECT user_id, tick, max(value) OVER x - min(value) OVER x < 15 AND max(value) OVER x >= 20 AND count(*) OVER x = 3 AS steady FROM series
  WINDOW x AS (PARTITION BY user_id ORDER BY tick ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT user_id, count(*) FILTER (WHERE steady) AS n_steady, min(tick) FILTER (WHERE steady) AS first_steady FROM w GROUP BY user_id""")
def steady_windows(spark, sf):
    out = C.steady(V.series(spark, sf), ["user_id"], "tick", "value", 3, 15, 20)
    return out.groupBy("user_id").agg(F.count_if("steady").alias("n_steady"), F.min(F.when(F.col("steady"), F.col("tick"))).alias("first_steady"))


@query("tick_sequence_check", "WIN20", """
WITH t AS (SELECT run_id, tick, max(us) AS us FROM cells GROUP BY run_id, tick),
c AS (SELECT run_id, tick, row_number() OVER w - 1 = tick AS in_seq, coalesce(us > lag(us) OVER w, true) AS rises FROM t WINDOW w AS (PARTITION BY run_id ORDER BY tick))
SELECT run_id, count(*) AS n_ticks, bool_and(in_seq) AS sequence_ok, bool_and(rises) AS clock_ok FROM c GROUP BY run_id""")
def tick_sequence_check(spark, sf):
    ticks = V.cells(spark, sf).groupBy("run_id", "tick").agg(F.max("us").alias("us"))
    out = S.scan(ticks, ["run_id"], ["tick"], S.tick_chunk("tick"), i=S.count(before=True), p=S.previous(F.col("us")))
    return out.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_ticks"), F.bool_and(F.col("i") == F.col("tick")).alias("sequence_ok"),
        F.bool_and(F.coalesce(F.col("us") > F.col("p"), F.lit(True))).alias("clock_ok"),
    )


@query("schedule_segments", "WIN21", f"""
WITH s AS (SELECT user_id, tick, k AS rate, (us - {V.T0_US}) // 1000000 AS t0 FROM series)
SELECT user_id, tick, rate, lead(t0, 1, 2592000) OVER w - t0 AS length, coalesce(t0 > lag(t0) OVER w, true) AS rises FROM s WINDOW w AS (PARTITION BY user_id ORDER BY tick)""")
def schedule_segments(spark, sf):
    base = V.series(spark, sf).select("user_id", "tick", F.col("k").alias("rate"), F.floor((F.col("us") - V.T0_US) / 1000000).alias("t0"))
    out = S.scan(base, ["user_id"], ["tick"], S.tick_chunk("tick"), n=S.following(F.col("t0")), p=S.previous(F.col("t0")))
    return out.select(
        "user_id", "tick", "rate", (F.coalesce("n", F.lit(2592000)) - F.col("t0")).alias("length"),
        F.coalesce(F.col("t0") > F.col("p"), F.lit(True)).alias("rises"),
    )


LEASE_SQL = """WITH x AS (SELECT actor, CAST(t_start AS DOUBLE) AS s, CAST(coalesce(t_revert + 8, t_start + 120) AS DOUBLE) AS e FROM orders_x),
x2 AS (SELECT actor, s, max(e) AS e FROM x WHERE e > s GROUP BY actor, s),
r AS (SELECT *, max(e) OVER (PARTITION BY actor ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x2),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY actor ORDER BY s) AS span FROM r),
m AS (SELECT actor, min(s) AS s, max(e) AS e FROM n GROUP BY actor, span)"""


def leases(spark, sf):
    x = V.interventions(spark, sf)
    end = I.lease_end(F.col("t_start"), F.col("t_revert"), 8.0, 120.0)
    return x.select("actor", "id", F.col("t_start").cast("double").alias("s"), end.cast("double").alias("e")).where("e > s")


@query("merged_intervals", "WIN14", LEASE_SQL + f"SELECT actor, {r6('s')} AS s, {r6('e')} AS e FROM m")
def merged_intervals(spark, sf):
    return I.merge(leases(spark, sf), ["actor"], "s", "e")


@query("interval_totals", "WIN14", LEASE_SQL + f"""SELECT actor, count(*) AS n_spans, {r6('sum(e - s)')} AS total, {r6('max(e - s)')} AS longest FROM m GROUP BY actor""")
def interval_totals(spark, sf):
    return I.merge(leases(spark, sf), ["actor"], "s", "e").groupBy("actor").agg(
        F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("e") - F.col("s")).alias("total"), F.max(F.col("e") - F.col("s")).alias("longest")
    )


@query("blind_time", "WIN15", LEASE_SQL + f""",
c AS (SELECT actor, greatest(s, 9200) AS s, least(e, 11200) AS e FROM m WHERE least(e, 11200) > greatest(s, 9200)),
i AS (SELECT o_custkey AS actor, CAST(epoch_us(o_orderdate) // 86400000000 AS DOUBLE) AS s, CAST(epoch_us(o_orderdate) // 86400000000 + 30 AS DOUBLE) AS e FROM orders WHERE o_orderpriority = '1-URGENT'),
ic AS (SELECT actor, greatest(s, 9200) AS s, max(least(e, 11200)) AS e FROM i WHERE least(e, 11200) > greatest(s, 9200) GROUP BY 1, 2),
ir AS (SELECT *, max(e) OVER (PARTITION BY actor ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ic),
iu AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY actor ORDER BY s) AS span FROM ir),
im AS (SELECT actor, min(s) AS s, max(e) AS e FROM iu GROUP BY actor, span),
b AS (SELECT actor, sum(e - s) AS blind, max(e - s) AS longest, count(*) AS n_spans FROM c GROUP BY actor),
k AS (SELECT actor, sum(e - s) AS incident FROM im GROUP BY actor),
o AS (SELECT c.actor, sum(greatest(0.0, least(c.e, im.e) - greatest(c.s, im.s))) AS ov FROM c JOIN im ON im.actor = c.actor GROUP BY c.actor)
SELECT b.actor, {r6('blind')} AS blind_s, {r6('blind / 2000.0')} AS of_uptime, {r6('coalesce(ov, 0) / incident')} AS of_incident, {r6('longest')} AS longest_s, n_spans
FROM b LEFT JOIN k USING (actor) LEFT JOIN o USING (actor)""")
def blind_time(spark, sf):
    lo, hi = F.lit(9200.0), F.lit(11200.0)
    blind = I.merge(I.clip(leases(spark, sf), "s", "e", lo, hi), ["actor"], "s", "e")
    orders = V.table(spark, sf, "orders")
    day = F.floor(V.micros(orders, "o_orderdate") / DAY_US).cast("double")
    incidents = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("actor"), day.alias("s"), (day + 30).alias("e"))
    incident = I.merge(I.clip(incidents, "s", "e", lo, hi), ["actor"], "s", "e")
    per = blind.groupBy("actor").agg(
        F.sum(F.col("e") - F.col("s")).alias("blind_s"), F.max(F.col("e") - F.col("s")).alias("longest_s"), F.count(F.lit(1)).alias("n_spans")
    )
    size = incident.groupBy("actor").agg(F.sum(F.col("e") - F.col("s")).alias("incident_s"))
    both = I.overlap_seconds(blind, incident, ["actor"], "s", "e")
    out = per.join(size, "actor", "left").join(both, "actor", "left")
    return out.select(
        "actor", "blind_s", (F.col("blind_s") / 2000.0).alias("of_uptime"),
        (F.coalesce("overlap", F.lit(0.0)) / F.col("incident_s")).alias("of_incident"), "longest_s", "n_spans",
    )


@query("intervention_gaps", "WIN16 JN6", f"""
WITH p AS (SELECT actor, id, t_start, t_revert, lead(t_start) OVER (PARTITION BY actor ORDER BY t_start, id) AS nxt FROM orders_x)
SELECT actor, count(*) FILTER (WHERE nxt IS NOT NULL AND t_revert IS NOT NULL) AS n_gaps, {r6('avg(CASE WHEN t_revert IS NOT NULL THEN nxt - t_revert END)')} AS gap_mean,
 min(CASE WHEN t_revert IS NOT NULL THEN nxt - t_revert END) AS gap_min, count(t_revert) AS n_holds, {r6('avg(t_revert - t_start)')} AS hold_mean FROM p GROUP BY actor""")
def intervention_gaps(spark, sf):
    x = V.interventions(spark, sf)
    chunk = S.range_chunk("t_start", S.even_width(x, ["actor"], "t_start"))
    out = S.scan(x, ["actor"], ["t_start", "id"], chunk, nxt=S.following(F.col("t_start")))
    gap = F.when(F.col("t_revert").isNotNull(), F.col("nxt") - F.col("t_revert"))
    return out.groupBy("actor").agg(
        F.count(gap).alias("n_gaps"), F.avg(gap).alias("gap_mean"), F.min(gap).alias("gap_min"),
        F.count("t_revert").alias("n_holds"), F.avg(F.col("t_revert") - F.col("t_start")).alias("hold_mean"),
    )


@query("changed_values", "ST8 FN7", """
WITH p AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY tick) AS pv FROM series)
SELECT user_id, tick, event_id FROM p WHERE pv IS NULL OR abs(value - pv) >= 5 OR tick % 30 = 0""")
def changed_values(spark, sf):
    out = C.changes(V.series(spark, sf), ["user_id"], ["tick"], S.tick_chunk("tick"), "value", 5.0, 30, "tick")
    return out.select("user_id", "tick", "event_id")
