"""The same operators over streams of the driver tables, drained with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import patches as P
from gaugeline.plans import alarm as PA
from gaugeline.plans import ingest as PI
from gaugeline.plans import views as V
from gaugeline.plans.registry import query, r6
from gaugeline.plans.views import SQL_VIEWS
from gaugeline.session import fresh_path
from gaugeline.streaming import feeds as D
from gaugeline.streaming import machines as G
from gaugeline.streaming import timers as T


def event_feed(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return D.file_feed(spark, f"{sf}/events.parque[t]", schema)  # a pattern, so that one file and a folder of parts are both read


def timed(stream):
    return V.ev_columns(stream).withColumn("at", F.timestamp_micros("us"))


def staged(spark, rows, label, cuts):
    """Write rows as consecutive time slices, so the feed sees them in several batches."""
    return staged_rows(spark, rows, label, cuts)[0]


def staged_rows(spark, rows, label, cuts):
    """The feed of :func:`staged`, and the number of its rows."""
    path, count = fresh_path(spark, label), rows.count()
    files = 1 + count // ROWS_PER_FILE  # of each slice, so that a batch is a slice
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = rows
        if lo is not None:
            part = part.where(F.col("us") >= lo)
        if hi is not None:
            part = part.where(F.col("us") < hi)
        part.repartition(files).write.mode("append").parquet(path)
    return D.file_feed(spark, path, rows.schema, files_per_trigger=files), count


def ended(spark, rows, label, processor, schema):
    """What ``processor`` emits for rows that come in the slices, its keys in bundles of a few thousand rows."""
    feed, count = staged_rows(spark, rows, label, CUTS)
    return drained(spark, T.ending(watched(feed, "6 hours"), processor, schema, 64 + count // ROWS_PER_BUNDLE), schema, label)


DAY_US = 86400 * 10**6
ROWS_PER_FILE = 1_000_000
ROWS_PER_BUNDLE = 10_000
CUTS = (V.T0_US + 10 * 2 * V.TICK_US, V.T0_US + 20 * 2 * V.TICK_US)


def drained(spark, stream, schema, label, checkpoint=None):
    """All rows of a stateful stream, drained to a table."""
    out, provider = fresh_path(spark, label), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, D.ROCKSDB)  # a session setting only; the caller's is put back
    try:
        D.run_available(stream, D.append_batches(out), label=label, checkpoint=checkpoint)
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    return spark.read.schema(schema).parquet(f"{out}/epoch=*")


def folded(spark, stream, keys, step, order, schema, label, checkpoint=None, initial=None):
    return drained(spark, G.fold(stream, keys, step, order, schema, [c.split()[0] for c in schema.split(", ")], initial), schema, label, checkpoint)


def watched(rows, delay):
    """Rows with ``us`` as event time, behind a watermark of ``delay``."""
    return rows.withColumn("at", F.timestamp_micros("us")).withWatermark("at", delay)


@query("stream_alarm_states", "ST3 ST1 SRC10", "SELECT user_id, tick, state, prev, false AS rejected FROM trace")
def stream_alarm_states(spark, sf):
    rows = V.readings(spark, sf).select("user_id", "tick", "us", "status", "suspect", "act")
    schema = "user_id bigint, tick bigint, us bigint, status string, suspect boolean, act boolean, state string, prev string, rejected boolean"
    out = folded(spark, staged(spark, rows, "readings", CUTS), ["user_id"], G.alarm_step(), "tick", schema, "alarm")
    return out.select("user_id", "tick", "state", "prev", "rejected")


SQL_VIEWS["readings_f"] = f"""SELECT user_id, row_number() OVER w - 1 AS tick, us, CASE WHEN row_number() OVER w = 1 THEN 'warming_up' WHEN k % 11 = 0 THEN 'unknown' ELSE 'scored' END AS status, suspect, act
  FROM readings WHERE us >= {CUTS[0]} WINDOW w AS (PARTITION BY user_id ORDER BY tick)"""
SQL_VIEWS["trace_f"] = V._machine("readings_f", "trace_f")


@query("stream_forked_replay", "ST12 ST19", f"""
SELECT 'forked' AS mode, user_id, us, state, prev FROM trace WHERE us >= {CUTS[0]} UNION ALL SELECT 'cold' AS mode, user_id, us, state, prev FROM trace_f""")
def stream_forked_replay(spark, sf):
    """A stream stopped at a cut: a new one that starts from the state in its checkpoint goes on as if nothing
    had happened, and one that starts without it warms up again."""
    keys = ["user_id"]
    rows = V.readings(spark, sf).select("user_id", "tick", "us", "suspect", "act", (F.col("k") % 11 != 0).alias("usable"))
    schema = "user_id bigint, tick bigint, us bigint, suspect boolean, act boolean, usable boolean, status string, state string, prev string, rejected boolean"
    step, checkpoint = G.replayed(G.alarm_step()), fresh_path(spark, "stopped")
    folded(spark, staged(spark, rows.where(F.col("us") < CUTS[0]), "before", ()), keys, step, "tick", schema, "before", checkpoint)
    rest, out = rows.where(F.col("us") >= CUTS[0]), []
    for mode, initial in (("forked", G.stored_state(spark, checkpoint, keys)), ("cold", None)):
        told = folded(spark, staged(spark, rest, mode, CUTS[1:]), keys, step, "tick", schema, mode, initial=initial)
        out.append(told.select(F.lit(mode).alias("mode"), "user_id", "us", "state", "prev"))
    return out[0].unionByName(out[1])


@query("stream_range_guard", "ST5", "SELECT 'R' || lpad(CAST(l.g AS VARCHAR), 6, '0') AS run_id, l.tick, active AS guard FROM loads l JOIN guards m ON m.g = l.g AND m.rn = l.rn")
def stream_range_guard(spark, sf):
    rows = PA.run_loads(spark, sf).select("run_id", "tick", "load", (F.lit(V.T0_US) + F.col("tick") * V.TICK_US).alias("us"))
    schema = "run_id string, tick bigint, load double, us bigint, guard boolean, rejected boolean"
    return folded(spark, staged(spark, rows, "loads", CUTS), ["run_id"], G.guard_step(50.0), "tick", schema, "guard").select("run_id", "tick", "guard")


IDLE_US = 4 * DAY_US
SQL_VIEWS["idle_msgs"] = """SELECT user_id, tick, us, 'b' || CAST(tick // 6 - CASE WHEN k % 10 = 0 AND tick >= 6 THEN 1 ELSE 0 END AS VARCHAR) AS boot, tick * 2 + k % 5 AS seq,
  coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY tick) > 345600000000, true) AS anew FROM series"""
SQL_VIEWS["idle_reads"] = """SELECT user_id, tick, us, boot, seq, true AS accepted, CAST(NULL AS BIGINT) AS confirmed, CAST([] AS VARCHAR[]) AS retired FROM idle_msgs WHERE tick = 0
  UNION ALL SELECT user_id, tick, us, CASE WHEN taken THEN boot ELSE pb END AS boot, CASE WHEN taken THEN seq ELSE ps END AS seq, taken AS accepted,
    CASE WHEN anew THEN NULL WHEN taken THEN us ELSE pc END AS confirmed, CASE WHEN anew THEN [] WHEN taken AND boot <> pb THEN list_append(pr, pb) ELSE pr END AS retired
  FROM (SELECT m.*, f.boot AS pb, f.seq AS ps, f.confirmed AS pc, f.retired AS pr, m.anew OR CASE WHEN m.boot = f.boot THEN m.seq > f.seq ELSE NOT list_contains(f.retired, m.boot) END AS taken
    FROM idle_reads f JOIN idle_msgs m ON m.user_id = f.user_id AND m.tick = f.tick + 1)"""


@query("stream_monotone_reads", "ST7", "SELECT user_id, tick, accepted, confirmed AS confirmed_at FROM idle_reads")
def stream_monotone_reads(spark, sf):
    """A device that was silent for four days starts anew, so its state, left boots included, ends."""
    s = V.series(spark, sf)
    back = F.when((F.col("k") % 10 == 0) & (F.col("tick") >= 6), 1).otherwise(0)
    rows = s.select("user_id", "tick", "us", F.concat(F.lit("b"), (F.floor(F.col("tick") / 6) - back).cast("string")).alias("boot"), (F.col("tick") * 2 + F.col("k") % 5).alias("seq"))
    schema = "user_id bigint, tick bigint, accepted boolean, confirmed_at bigint"
    return drained(spark, T.ending(watched(staged(spark, rows, "messages", CUTS), "6 hours"), T.Freshness(["user_id"], IDLE_US), schema), schema, "fresh")


@query("stream_changed_values", "ST8", """
WITH p AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY tick) AS pv FROM series) SELECT user_id, tick, event_id FROM p WHERE pv IS NULL OR abs(value - pv) >= 5 OR tick % 30 = 0""")
def stream_changed_values(spark, sf):
    rows = V.series(spark, sf).select("user_id", "tick", "us", "event_id", "value")
    schema = "user_id bigint, tick bigint, us bigint, event_id bigint, value double, send boolean, rejected boolean"
    out = folded(spark, staged(spark, rows, "values", CUTS), ["user_id"], G.delta_step(5.0, 30), "tick", schema, "delta")
    return out.where("send").select("user_id", "tick", "event_id")


@query("stream_latest_state", "SRC10 SRC11 ST10", f"SELECT user_id, event_type, {r6('arg_max(value, (us, event_id))')} AS value, max(us) AS us FROM ev GROUP BY 1, 2")
def stream_latest_state(spark, sf):
    path = fresh_path(spark, "latest")
    feed = staged(spark, V.ev(spark, sf).select("user_id", "event_type", "us", "event_id", "value"), "events", CUTS)
    D.run_available(feed, D.upsert_batches(path, ["user_id", "event_type"], ["us", "event_id"]), label="latest")
    return D.read_latest(spark, path, ["user_id", "event_type"], ["us", "event_id"]).select("user_id", "event_type", "value", "us")


def patch_log(spark, sf):
    """Leaves of the patches that events make to their device's document."""
    return P.leaves(V.twin_patches(spark, sf), ["user_id"], ["us", "event_id"], "patch")


def refuses(entities, number):
    """A seventh of the devices does not answer in a batch."""
    return entities.where((F.col("user_id") + number) % 7 != 0)


@query("stream_merge_patches", "SRC11 FN8", """
SELECT user_id, path, value, us FROM twin_writes w WHERE value IS NOT NULL AND taken AND NOT EXISTS (SELECT 1 FROM twin_writes l WHERE l.user_id = w.user_id AND l.taken AND (l.us, l.event_id) > (w.us, w.event_id)
  AND (l.path = w.path OR starts_with(w.path, l.path || '/') OR starts_with(l.path, w.path || '/')))""")
def stream_merge_patches(spark, sf):
    """Documents as the devices have them: patches of a device that did not answer come again with the next
    batch, those of the last batch are still waiting."""
    keys, order, schema = ["user_id"], ["us", "event_id"], "user_id bigint, us bigint, event_id bigint, path array<string>, value string"
    path, outbox = fresh_path(spark, "twins"), fresh_path(spark, "outbox")
    shrink = lambda log: P.compact(log, keys, order)
    tiers = D.Tiers(spark, path, schema, shrink)
    feed = staged(spark, V.twin_patches(spark, sf), "patches", CUTS)
    write = D.delivered_batches(tiers, outbox, keys, schema, refuses, shrink)
    D.run_available(feed, lambda batch, number: write(P.leaves(batch, keys, order, "patch"), number), label="patches")
    return P.document(tiers.read(), keys, order).select("user_id", F.array_join("path", "/").alias("path"), "value", "us")


@query("stream_window_counts", "AG50 SRC10", f"SELECT us // 86400000000 AS day, event_type, count(*) AS n, {r6('sum(value)')} AS total FROM ev GROUP BY 1, 2")
def stream_window_counts(spark, sf):
    path = fresh_path(spark, "windows")
    counted = D.windowed_counts(timed(event_feed(spark, sf)), "at", ["event_type"], "1 day", "2 days", [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")])
    rows = counted.select(F.floor(F.unix_micros("w.start") / 86400000000).cast("bigint").alias("day"), "event_type", "n", "total")
    D.run_available(rows, D.upsert_batches(path, ["day", "event_type"], ["n"]), mode="update", label="windows")
    return D.read_latest(spark, path, ["day", "event_type"], ["n"])


@query("stream_sessions", "ST16", """
WITH d AS (SELECT user_id, us, CASE WHEN us - lag(us) OVER w <= 43200000000 THEN 0 ELSE 1 END AS f FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)), s AS (SELECT user_id, us, sum(f) OVER (PARTITION BY user_id ORDER BY us) AS g FROM d)
SELECT user_id, min(us) AS t0, count(*) AS n FROM s GROUP BY user_id, g""")
def stream_sessions(spark, sf):
    path = fresh_path(spark, "sessions")
    grouped = D.sessions(timed(event_feed(spark, sf)), "at", ["user_id"], "12 hours", "2 days", [F.count(F.lit(1)).alias("n"), F.min("us").alias("t0")])
    D.run_available(grouped.select("user_id", "t0", "n"), D.append_batches(path), mode="complete", label="sessions")
    return D.last_epoch(spark, path)


HORIZON_US = 3 * DAY_US
SQL_VIEWS["kept_msgs"] = """SELECT user_id, k, min(us) AS us FROM ev GROUP BY user_id, k
  UNION ALL SELECT d.user_id, d.k, min(e.us) AS us FROM kept_msgs d JOIN ev e ON e.user_id = d.user_id AND e.k = d.k AND e.us >= d.us + 259200000000 GROUP BY d.user_id, d.k"""


@query("stream_first_deliveries", "ST17 ST1", "SELECT user_id, k, us FROM kept_msgs")
def stream_first_deliveries(spark, sf):
    """A message that comes again within three days of the delivery that was kept is dropped."""
    rows, schema = V.ev(spark, sf).select("user_id", "k", "us"), "user_id bigint, k bigint, us bigint"
    return ended(spark, rows, "deliveries", T.FirstDeliveries(["user_id", "k"], HORIZON_US), schema)


@query("stream_snapshots", "SRC10 PRJ1", f"SELECT run_id, tick, entity, {r6('CASE WHEN n % 7 <> 3 THEN rate END')} AS tx_rate FROM cells")
def stream_snapshots(spark, sf):
    from gaugeline.sources.snapshots import flatten

    lines, path = fresh_path(spark, "lines"), fresh_path(spark, "long")
    PI.snapshot_lines(spark, sf).select("value").write.text(lines)
    long = flatten(D.snapshot_feed(spark, lines)).where("prop = 'txRate'").select("run_id", "tick", "entity", F.col("num").alias("tx_rate"))
    D.run_available(long, D.append_batches(path), label="snapshots")
    return spark.read.schema("run_id string, tick bigint, entity string, tx_rate double").parquet(f"{path}/epoch=*")


@query("stream_expired_leases", "ST18", """
WITH n AS (SELECT user_id, event_type AS target, us, lead(us) OVER (PARTITION BY user_id, event_type ORDER BY us) AS nx, max(us) OVER () // 1000 * 1000 - 21600000000 AS watermark FROM ev)
SELECT user_id, target, us + 172800000000 AS expired_at FROM n WHERE nx > us + 172800000000 OR (nx IS NULL AND us + 172800000000 <= watermark)""")
def stream_expired_leases(spark, sf):
    """Leases of two days, renewed by events; also those that are never renewed, up to the final watermark."""
    rows, schema = V.ev(spark, sf).select("user_id", F.col("event_type").alias("target"), "us"), "user_id bigint, target string, expired_at bigint"
    return ended(spark, rows, "renewals", T.Leases(["user_id", "target"], 2 * DAY_US), schema)
