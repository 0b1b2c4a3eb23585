"""Snapshot files, sidecars, logs and exports, written from the driver tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import names as N
from gaugeline.operators import envelope as O
from gaugeline.plans import envelope as E
from gaugeline.plans import views as V
from gaugeline.plans.registry import query, r6
from gaugeline.plans.views import SQL_VIEWS
from gaugeline.session import fresh_path
from gaugeline.sources import logs as L
from gaugeline.sources import sinks as K
from gaugeline.sources import snapshots as J


def snapshot_lines(spark, sf):
    """One JSON line per run and tick. Odd cells carry wrong types, as live feeds do."""
    c = V.cells(spark, sf)
    quote = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    tx = F.when(F.col("n") % 7 == 3, F.lit('"bad"')).otherwise(F.col("rate").cast("string"))
    valid = F.when(F.col("n") % 5 == 4, F.lit('"yes"')).otherwise(F.col("ok").cast("string"))
    state = F.when(F.col("rate") >= 50, "up").when(F.col("rate") < 20, "down").otherwise("odd")
    status = F.concat(F.lit('{"state":'), quote(state), F.lit("}"))
    wrapped = F.when(F.col("tick") % 2 == 0, F.concat(F.lit('{"properties":'), status, F.lit("}"))).otherwise(status)
    thing = F.concat(
        quote(F.col("entity")), F.lit(':{"attributes":{"type":"link"},"features":{"traffic":{"txRate":'), tx, F.lit(',"rateValid":'), valid,
        F.lit(',"qdiscValid":'), F.col("ok").cast("string"), F.lit(',"lossPct":'), (F.col("rate") / 4).cast("string"),
        F.lit(',"note":null,"qdiscCounters":{"a":1}},"status":'), wrapped, F.lit("}}"),
    )
    things = F.array_join(F.array_sort(F.collect_list(thing)), ",")
    line = F.concat(
        F.lit('{"tick":'), F.col("tick").cast("string"), F.lit(',"t_source":'), (F.max("us") / 1e6).cast("string"), F.lit(',"run":{"run_id":'), quote(F.col("run_id")),
        F.lit(',"collector_version":"v'), (F.col("g") % 2).cast("string"), F.lit('"},"things":{'), things, F.lit("}}"),
    )
    return c.groupBy("run_id", "g", "tick").agg(line.alias("value"))


def snapshots(spark, sf):
    path = fresh_path(spark, "snap")
    snapshot_lines(spark, sf).select("value").write.text(path)
    return J.read_snapshots(spark, path)


SQL_VIEWS["scells"] = "SELECT *, CASE WHEN rate >= 50 THEN 'up' WHEN rate < 20 THEN 'down' ELSE 'odd' END AS state FROM cells"


@query("snapshot_long_table", "SRC1 PRJ1 PRJ2 PRJ3", f"""
SELECT run_id, tick, entity, 'traffic' AS feature, 'txRate' AS prop, {r6("CASE WHEN n % 7 <> 3 THEN rate END")} AS num, CAST(NULL AS BOOLEAN) AS flag, CASE WHEN n % 7 = 3 THEN 'bad' END AS txt, CAST(NULL AS BIGINT) AS up FROM scells
UNION ALL SELECT run_id, tick, entity, 'traffic', 'rateValid', NULL, CASE WHEN n % 5 <> 4 THEN ok END, CASE WHEN n % 5 = 4 THEN 'yes' END, NULL FROM scells
UNION ALL SELECT run_id, tick, entity, 'traffic', 'qdiscValid', NULL, ok, NULL, NULL FROM scells
UNION ALL SELECT run_id, tick, entity, 'traffic', 'lossPct', {r6("CASE WHEN ok THEN rate / 4.0 END")}, NULL, NULL, NULL FROM scells
UNION ALL SELECT run_id, tick, entity, 'traffic', 'note', NULL, NULL, NULL, NULL FROM scells
UNION ALL SELECT run_id, tick, entity, 'status', 'state', NULL, NULL, state, CASE state WHEN 'up' THEN 1 WHEN 'down' THEN 0 END FROM scells""")
def snapshot_long_table(spark, sf):
    return J.flatten(snapshots(spark, sf)).select("run_id", "tick", "entity", "feature", "prop", "num", "flag", "txt", "up")


@query("snapshot_violations", "PRJ4", """
SELECT run_id, entity, v AS violation, count(*) AS n FROM (SELECT run_id, entity, unnest([CASE WHEN n % 7 = 3 THEN 'number' END, CASE WHEN n % 5 = 4 THEN 'flag' END, CASE WHEN state = 'odd' THEN 'state' END, CASE WHEN NOT ok THEN 'stray_loss' END]) AS v FROM scells) WHERE v IS NOT NULL GROUP BY ALL""")
def snapshot_violations(spark, sf):
    clean = J.sanitize(J.flatten(snapshots(spark, sf)))
    return clean.where("violation is not null").groupBy("run_id", "entity", "violation").agg(F.count(F.lit(1)).alias("n"))


@query("wide_feature_rows", "PRJ1 PRJ22", f"""
SELECT run_id, tick, {", ".join(r6(f"max(CASE WHEN entity = '{e}' AND n % 7 <> 3 THEN rate END)") + f' AS "{e}.traffic.txRate"' for e in V.ENTITIES)} FROM cells GROUP BY run_id, tick""")
def wide_feature_rows(spark, sf):
    long = J.flatten(snapshots(spark, sf)).where("prop = 'txRate'").withColumn("name", F.concat_ws(".", "entity", "feature", "prop"))
    columns = [f"{e}.traffic.txRate" for e in V.ENTITIES]
    return long.groupBy("run_id", "tick").pivot("name", columns).agg(F.first("num"))


@query("line_faults", "SRC2 SRC7", """
SELECT kind, count(*) AS n FROM (SELECT run_id, tick, CASE WHEN sum(n) % 11 = 0 THEN 'blank' WHEN sum(n) % 11 = 1 THEN 'broken' WHEN sum(n) % 11 = 2 THEN 'pointer' ELSE 'ok' END AS kind FROM cells GROUP BY run_id, tick) GROUP BY kind""")
def line_faults(spark, sf):
    size = V.cells(spark, sf).groupBy("run_id", "tick").agg(F.sum("n").alias("m"))
    rows = snapshot_lines(spark, sf).join(size, ["run_id", "tick"])
    damaged = (
        F.when(F.col("m") % 11 == 0, "  ").when(F.col("m") % 11 == 1, F.substring("value", 1, 40))
        .when(F.col("m") % 11 == 2, "version https://git-lfs.github.com/spec/v1").otherwise(F.col("value"))
    )
    path = fresh_path(spark, "lines")
    rows.select(damaged.alias("value")).write.text(path)
    return J.read_lines(spark, path).groupBy(F.col("line_kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("many_files_union", "SRC3 SET1 SRC6", """
SELECT run_id, profile, count(*) AS n_rows, count(extra) AS n_extra FROM (SELECT c.run_id, r.profile, CASE WHEN r.split = 'test' THEN c.n END AS extra FROM cells c JOIN runs r USING (run_id) WHERE r.split = 'test' OR r.profile <> 'p0') GROUP BY ALL""")
def many_files_union(spark, sf):
    meta = V.runs(spark, sf).select("run_id", "split", "profile")
    rows = V.cells(spark, sf).select("run_id", "tick", "entity", "rate", "n").join(meta, "run_id")
    train, test = fresh_path(spark, "train"), fresh_path(spark, "test")
    rows.where("split = 'train'").select("run_id", "tick", "entity", "rate").write.parquet(train)
    rows.where("split = 'test'").select("run_id", "tick", "entity", "rate", "n").write.parquet(test)
    both = spark.read.parquet(train).unionByName(spark.read.parquet(test), allowMissingColumns=True)
    kept = both.join(meta, "run_id").where("split = 'test' or profile <> 'p0'")
    return kept.groupBy("run_id", "profile").agg(F.count(F.lit(1)).alias("n_rows"), F.count("n").alias("n_extra"))


# Sidecars with planted drift: count, events, record, constants, hash of the data, event clock, acceptance.
@query("sidecar_check", "SRC4", """
WITH c AS (SELECT run_id, tick, max(us) AS us FROM ev GROUP BY ALL)
SELECT r.run_id, concat_ws(',', CASE WHEN n_events % 3 = 0 THEN 'count' END, CASE WHEN (grp = 'F') <> (fault IS NOT NULL AND n_events % 2 = 0) THEN 'events' END, CASE WHEN g % 6 = 4 THEN 'record' END, CASE WHEN g % 5 = 1 THEN 'constants' END,
 CASE WHEN n_events % 7 = 0 THEN 'hash' END, CASE WHEN fault IS NOT NULL AND n_events % 2 = 0 AND n_events % 11 < 5 AND c.us IS NOT NULL THEN 'clock' END, CASE WHEN n_events % 5 = 0 THEN 'not_passed' END) AS problems
FROM runs r LEFT JOIN c ON c.run_id = r.run_id AND c.tick = r.inject""")
def sidecar_check(spark, sf):
    clock = V.ev(spark, sf).groupBy("run_id", F.col("tick").alias("inject")).agg(F.max("us").alias("at"))
    digest = F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum("event_id").cast("string")), 256)
    data = V.ev(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), digest.alias("sha"))
    r = V.runs(spark, sf).join(clock, ["run_id", "inject"], "left").join(data, "run_id")
    path, n = fresh_path(spark, "sidecar"), F.col("n_events")
    event = F.struct(F.lit("inject").alias("kind"), F.col("inject").alias("tick"), (F.col("at") + F.when(n % 11 < 5, 1).otherwise(0)).alias("t_source"))
    events = F.when(F.col("fault").isNotNull() & (n % 2 == 0), F.array(event))
    r.select(
        "run_id", F.struct(F.when(F.col("g") % 6 == 4, F.concat("grp", F.lit("?"))).otherwise(F.col("grp")).alias("grp"), "fault").alias("record"),
        F.struct(F.when(F.col("g") % 5 == 1, 2).otherwise(1).cast("bigint").alias("warmup_ticks")).alias("constants"),
        F.when(n % 7 == 0, F.reverse("sha")).otherwise(F.col("sha")).alias("sha256"),
        F.coalesce(events, F.array().cast("array<struct<kind:string,tick:bigint,t_source:bigint>>")).alias("events"),
        F.struct((n + F.when(n % 3 == 0, 1).otherwise(0)).alias("n_snapshots"), (n % 5 != 0).alias("passed")).alias("checks"),
    ).write.json(path)
    schema = ("run_id string, record struct<grp:string,fault:string>, constants struct<warmup_ticks:bigint>, sha256 string, events array<struct<kind:string,tick:bigint,t_source:bigint>>, "
              "checks struct<n_snapshots:bigint,passed:boolean>")
    side = spark.read.schema(schema).json(path)
    contract = V.runs(spark, sf).select("run_id", F.struct("grp", "fault").alias("signed"))
    told = side.select("run_id", F.explode("events").alias("e")).join(clock.select("run_id", F.col("inject").alias("tick"), "at"), (side["run_id"] == clock["run_id"]) & (F.col("e.tick") == F.col("tick")), "left").select(
        side["run_id"], (~F.col("e.t_source").eqNullSafe(F.col("at"))).alias("off")).groupBy("run_id").agg(F.max("off").alias("off"))
    joined = side.join(data, "run_id", "left").join(contract, "run_id", "left").join(told, "run_id", "left")
    notes = F.array(
        F.when(~F.col("checks.n_snapshots").eqNullSafe(F.col("n")), "count"), F.when((F.col("signed.grp") == "F") != (F.size("events") > 0), "events"),
        F.when(~(F.col("record.grp").eqNullSafe(F.col("signed.grp")) & F.col("record.fault").eqNullSafe(F.col("signed.fault"))), "record"),
        F.when(~F.col("constants.warmup_ticks").eqNullSafe(F.lit(1)), "constants"), F.when(~F.col("sha256").eqNullSafe(F.col("sha")), "hash"),
        F.when(F.col("off"), "clock"), F.when(~F.col("checks.passed"), "not_passed"),
    )
    return joined.select("run_id", F.array_join(F.filter(notes, lambda x: x.isNotNull()), ",").alias("problems"))


@query("load_split", "SRC5 SRT1", f"""
WITH s AS (SELECT entity, avg(v) AS mu, CASE WHEN stddev_samp(v) > 0 THEN stddev_samp(v) ELSE 1.0 END AS sd FROM lab WHERE split = 'train' AND tick >= 1 GROUP BY entity),
d AS (SELECT l.run_id, split, tick, entity, (v - mu) / sd AS z, (v - lag(v) OVER (PARTITION BY l.run_id, entity ORDER BY tick)) AS dv FROM lab l JOIN s USING (entity)),
t AS (SELECT run_id, split, tick, max(abs(z)) AS zmax, max(abs(dv)) AS dmax, count(z) AS nz FROM d WHERE tick >= 1 GROUP BY ALL)
SELECT run_id, tick, split, {r6('zmax')} AS zmax, {r6('dmax')} AS dmax, (SELECT count(DISTINCT entity) FROM ev) - nz AS n_missing FROM t WHERE split = 'test' OR nz = (SELECT count(DISTINCT entity) FROM ev)""")
def load_split(spark, sf):
    from gaugeline.operators import counters as C
    from gaugeline.operators import scan as S
    from gaugeline.plans.quality import labelled

    rows = labelled(spark, sf)
    sd = F.stddev_samp("v")
    scaler = rows.where("split = 'train' and tick >= 1").groupBy("entity").agg(F.avg("v").alias("mu"), F.when(sd > 0, sd).otherwise(1.0).alias("sd"))
    moved = C.delta(rows, ["run_id", "entity"], ["tick"], S.tick_chunk("tick"), "v", "dv").join(scaler, "entity").where("tick >= 1")
    per = moved.groupBy("run_id", "tick", "split").agg(
        F.max(F.abs((F.col("v") - F.col("mu")) / F.col("sd"))).alias("zmax"), F.max(F.abs("dv")).alias("dmax"), (V.n_entities(spark, sf) - F.count("v")).alias("n_missing")
    )
    return per.where("split = 'test' or n_missing = 0").orderBy("run_id", "tick")


@query("contract_check", "PRJ21 SET2", """
SELECT run_id, tick, array_to_string(list_sort(list_filter(['link-backup', 'link-click', 'link-error', 'link-purchase', 'link-signup'], lambda x: NOT list_contains(l, x))), ',') AS missing, array_to_string(list_sort(list_filter(l, lambda x: x NOT IN ('link-backup', 'link-click', 'link-error', 'link-purchase', 'link-signup'))), ',') AS extra,
 concat_ws(',', 'missing', CASE WHEN list_contains(l, 'link-view') THEN 'extra' END, CASE WHEN g % 2 = 1 THEN 'version' END) AS problems FROM (SELECT run_id, g, tick, list(entity) AS l FROM cells GROUP BY run_id, g, tick)""")
def contract_check(spark, sf):
    model = E.bounds(spark, sf).select("entity").where("entity <> 'link-view'").unionByName(spark.createDataFrame([("link-backup",)], "entity string"))
    return J.contract_problems(snapshots(spark, sf), model, "entity", "v0")


@query("required_columns", "PRJ22", """
SELECT run_id, tick, 6 - count(*) AS n_absent FROM cells GROUP BY run_id, tick""")
def required_columns(spark, sf):
    ticks = snapshots(spark, sf).select(F.col("run.run_id").alias("run_id"), "tick", F.map_keys("things").alias("have"))
    wanted = F.explode(F.array(*[F.lit(e) for e in (*V.ENTITIES, "link-backup")])).alias("entity")
    grid = ticks.select("run_id", "tick", "have", wanted)
    return grid.groupBy("run_id", "tick").agg(F.count_if(~F.array_contains("have", F.col("entity"))).alias("n_absent"))


@query("entity_updates", "PRJ10 PRJ13", f"""
SELECT run_id, tick, 'link-' || substr(entity, 6) || '-' || substr(entity, 6) AS thing, 'link' AS kind, CASE WHEN ok THEN 'lossPct,qdiscCounters,qdiscValid,rateValid,txRate' ELSE 'qdiscCounters,qdiscValid,rateValid,txRate' END AS props, NOT ok AS deletes_loss,
 CASE WHEN state = 'down' THEN 'critical' WHEN state <> 'up' THEN 'unknown' WHEN n % 7 = 3 THEN 'ok' WHEN rate / 300.0 > 0.9 THEN 'critical' WHEN rate / 300.0 > 0.7 THEN 'warning' ELSE 'ok' END AS health FROM scells""")
def entity_updates(spark, sf):
    from gaugeline.functions.health import link_health

    u = J.to_updates(snapshots(spark, sf))
    return u.select("run_id", "tick", "thing", "kind", "props", "deletes_loss", link_health(F.col("state"), F.lit(None).cast("double"), F.col("tx_rate"), F.lit(300.0)).alias("health"))


@query("audit_log_scan", "SRC8", """
SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS n_actors, min(event_id) AS first_seq FROM events GROUP BY event_type""")
def audit_log_scan(spark, sf):
    path = fresh_path(spark, "audit")
    V.ev(spark, sf).select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), "us", F.struct("user_id", "k").alias("input")).write.json(path)
    rows = spark.read.schema("seq bigint, kind string, us bigint, input struct<user_id:bigint,k:bigint>").json(path)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("input.user_id").alias("n_actors"), F.min("seq").alias("first_seq"))


@query("csv_export", "SRC12", f"""
SELECT entity, {r6('lo')} AS lo, {r6('hi')} AS hi, entity <> 'link-view' AS reproduced FROM bounds""")
def csv_export(spark, sf):
    path = fresh_path(spark, "csv")
    K.export_csv(E.train_cells(spark, sf).select("run_id", "tick", "entity", "rate"), path)
    back = spark.read.option("header", True).option("nullValue", "").schema("run_id string, tick bigint, entity string, rate double").csv(path)
    stored = E.bounds(spark, sf).withColumn("hi", F.when(F.col("entity") == "link-view", F.col("hi") + 1).otherwise(F.col("hi")))
    out = K.bounds_drift(back, stored, "entity", "rate")
    return out.withColumn("hi", F.when(F.col("entity") == "link-view", F.col("hi") - 1).otherwise(F.col("hi")))


@query("sealed_results", "SRC13 FN9", """
SELECT run_id, n_events, sha256('{"n_events":' || n_events || ',"n_ticks":' || n_ticks || ',"run_id":"' || run_id || '"}') AS seal FROM runs""")
def sealed_results(spark, sf):
    path = fresh_path(spark, "result")
    runs = V.runs(spark, sf).select("run_id", "n_ticks", "n_events")
    K.write_once(runs.withColumn("seal", K.sealed(runs, ["run_id", "n_ticks", "n_events"])), path)
    return spark.read.schema("run_id string, n_events bigint, seal string").json(path)


@query("sealed_documents", "FN9", """
WITH c AS (SELECT run_id, string_agg('"' || entity || '":{"n":' || n || ',"ok":' || ok || '}', ',' ORDER BY entity) AS t FROM (SELECT run_id, entity, count(*) AS n, bool_and(ok) AS ok FROM cells GROUP BY ALL) GROUP BY run_id),
d AS (SELECT run_id, '{"cells":{' || t || '},"fault":' || coalesce('"' || fault || '"', 'null') || ',"window":{"from":' || coalesce(inject::VARCHAR, 'null') || ',"to":' || coalesce(revert::VARCHAR, 'null') || '}}' AS doc FROM runs JOIN c USING (run_id))
SELECT run_id, doc, sha256(doc) AS seal FROM d""")
def sealed_documents(spark, sf):
    """Nested documents with maps and NULL fields, sealed by their canonical text."""
    per = V.cells(spark, sf).groupBy("run_id", "entity").agg(F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("ok"))
    maps = per.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("entity", F.struct("ok", "n")))).alias("cells"))  # one entry per entity
    docs = V.runs(spark, sf).join(maps, "run_id").select("run_id", "fault", F.struct(F.col("revert").alias("to"), F.col("inject").alias("from")).alias("window"), "cells")
    parts = ["fault", "window", "cells"]
    return docs.select("run_id", K.canonical_json(docs, parts).alias("doc"), K.sealed(docs, parts).alias("seal"))


@query("append_tick_log", "SRC14", "SELECT us // 86400000000 - 19723 AS day, count(*) AS n, max(event_id) AS last_event FROM ev GROUP BY 1")
def append_tick_log(spark, sf):
    path = fresh_path(spark, "ticklog")
    rows = V.ev(spark, sf).withColumn("day", (F.floor(F.col("us") / 86400000000) - 19723).cast("bigint")).select("day", "event_id", "value")
    K.append_log(rows.where("value < 50"), path, "day")
    K.append_log(rows.where("value >= 50"), path, "day")
    return spark.read.parquet(path).groupBy(F.col("day").cast("bigint").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


@query("column_kinds", "PRJ7 PRJ9", """
WITH n AS (SELECT c || p AS name, c AS head FROM (SELECT DISTINCT entity AS c FROM cells UNION ALL SELECT 'agg') CROSS JOIN (VALUES ('.traffic.txRate'), ('.traffic.rxBytes'), ('.capacity.bwMbps'), ('.traffic.rateValid'), ('.status.state'), ('.t_source'), ('.traffic.lossPct')) v(p))
SELECT name, CASE WHEN name LIKE '%.t_source' THEN 'meta' WHEN name LIKE '%.rxBytes' THEN 'cumulative' WHEN name LIKE '%.bwMbps' THEN 'config' WHEN name LIKE '%.rateValid' THEN 'bool' WHEN name LIKE '%.state' THEN 'text' ELSE 'numeric' END AS kind, nullif(head, 'agg') AS entity FROM n""")
def column_kinds(spark, sf):
    heads = V.cells(spark, sf).select(F.col("entity").alias("c")).distinct().unionByName(spark.createDataFrame([("agg",)], "c string"))
    suffix = F.explode(F.array(*[F.lit(x) for x in (".traffic.txRate", ".traffic.rxBytes", ".capacity.bwMbps", ".traffic.rateValid", ".status.state", ".t_source", ".traffic.lossPct")])).alias("p")
    named = heads.select("c", suffix).select(F.concat("c", "p").alias("name"))
    return named.select("name", N.column_kind(F.col("name")).alias("kind"), N.entity_of(F.col("name")).alias("entity"))


@query("numeric_coercion", "PRJ8", f"""
SELECT event_id, {r6("CASE WHEN k % 10 IN (0, 1, 2) THEN NULL ELSE value END")} AS number FROM ev""")
def numeric_coercion(spark, sf):
    m = F.col("k") % 10
    text = F.when(m == 0, "NaN").when(m == 1, "Infinity").when(m == 2, "abc").otherwise(F.col("value").cast("string"))
    return V.ev(spark, sf).select("event_id", O.finite(text).alias("number"))


@query("variant_training_set", "SRC6", """
WITH t AS (SELECT run_id, g, n_events FROM runs WHERE split = 'train'), o AS (SELECT min(g) AS old FROM t), s AS (SELECT min(g) AS new FROM runs WHERE split = 'test' AND grp = 'C'),
v AS (SELECT run_id, g, n_events FROM t WHERE g <> (SELECT old FROM o) UNION ALL SELECT run_id, g, n_events FROM runs WHERE g = (SELECT new FROM s))
SELECT v.run_id, v.n_events, (SELECT count(DISTINCT g % 2) FROM v) = 1 AS one_version FROM v""")
def variant_training_set(spark, sf):
    r = V.runs(spark, sf)
    train = r.where("split = 'train'")
    old, new = F.broadcast(train.agg(F.min("g").alias("old"))), F.broadcast(r.where("split = 'test' and grp = 'C'").agg(F.min("g").alias("new")))
    rows = K.replace_run(train.join(old), r.join(new), F.col("g") == F.col("old"), F.col("g") == F.col("new"), ["run_id", "g", "n_events"])
    versions = F.broadcast(rows.agg((F.count_distinct(F.col("g") % 2) == 1).alias("one_version")))
    return rows.join(versions).select("run_id", "n_events", "one_version")
