"""Telemetry views over the driver tables, in Spark and as SQL text for the checks.

``ev``      events with a device group as run (16 devices each), 12-hour ticks and ``k`` from props
``cells``   one row per (run, tick, entity): rate, and ok = every reading valid
``runs``    one row per run: split, group C/F, fault and its inject/revert ticks
``series``  one row per device event, tick = its position in the device's own order
``orders_x``  interventions: opened at the order date, closed at its last ship date
Only tests and checks depend on these; the operators take column names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import scan as S

T0_US = 1704067200000000
TICK_US = 43200000000
ENTITIES = ("link-click", "link-error", "link-purchase", "link-signup", "link-view")
INDICATORS = ("link-error", "link-signup")


class Views(dict):
    """SQL text by view name; a name has one definition."""

    def __setitem__(self, name: str, sql: str) -> None:
        if name in self:
            raise ValueError(f"view defined twice: {name}")
        super().__setitem__(name, sql)


SQL_VIEWS = Views({
    "ev": f"""SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  'R' || lpad(CAST(user_id // 16 AS VARCHAR), 6, '0') AS run_id, user_id // 16 AS g,
  (epoch_us(ts) - {T0_US}) // {TICK_US} AS tick, 'link-' || event_type AS entity FROM events""",
    "cells": """SELECT run_id, g, tick, entity, round(sum(value), 2) AS rate, bool_and(k % 25 <> 0) AS ok,
  count(*) AS n, max(us) AS us FROM ev GROUP BY run_id, g, tick, entity""",
    "runs": """SELECT run_id, g, CASE WHEN g % 2 = 0 THEN 'train' ELSE 'test' END AS split,
  CASE WHEN g % 4 = 3 THEN 'F' ELSE 'C' END AS grp, 'p' || CAST(g % 3 AS VARCHAR) AS profile,
  CASE WHEN g % 4 = 3 THEN CASE CAST(sum(k) AS BIGINT) % 3 WHEN 0 THEN 'degrade' WHEN 1 THEN 'admin_down' ELSE 'flood' END END AS fault,
  CASE WHEN g % 4 = 3 THEN 10 + CAST(sum(k) AS BIGINT) % 20 END AS inject,
  CASE WHEN g % 4 = 3 THEN 18 + CAST(sum(k) AS BIGINT) % 20 + count(*) % 7 END AS revert,
  max(tick) + 1 AS n_ticks, count(*) AS n_events FROM ev GROUP BY run_id, g""",
    "bounds": """SELECT entity, min(rate) AS lo, max(rate) AS hi FROM cells JOIN runs USING (run_id)
  WHERE split = 'train' AND ok AND tick >= 1 GROUP BY entity""",
    "scores": """SELECT run_id, tick, count(*) FILTER (WHERE ok AND (rate < lo OR rate > hi)) AS k,
  count(*) FILTER (WHERE ok AND (rate < lo OR rate > hi) AND entity IN ('link-error', 'link-signup')) AS k_indicator,
  count(*) FILTER (WHERE ok AND (rate < lo OR rate > hi) AND entity NOT IN ('link-error', 'link-signup')) AS k_rate,
  sum(CASE WHEN ok THEN greatest(lo - rate, rate - hi, 0.0) / greatest(hi - lo, 1.0) ELSE 0.0 END) AS excess,
  count(*) FILTER (WHERE ok) = (SELECT count(DISTINCT entity) FROM ev) AS judgeable
  FROM cells JOIN bounds USING (entity) GROUP BY run_id, tick""",
    "evalframe": """SELECT s.run_id, s.tick, r.grp, r.fault, coalesce(s.tick > r.inject AND s.tick <= r.revert, false) AS y,
  s.tick >= 1 AS in_eval, s.judgeable, s.judgeable AND s.k > 0 AS alarm, s.k, r.inject, r.revert
  FROM scores s JOIN runs r USING (run_id) WHERE r.split = 'test'""",
    "series": """SELECT user_id, event_id, us, value, k, event_type, run_id,
  row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS tick FROM ev""",
    "readings": """SELECT user_id, tick, us, k, value, event_type,
  CASE WHEN tick < 1 THEN 'warming_up' WHEN k % 11 = 0 THEN 'unknown' ELSE 'scored' END AS status,
  value > 60 AS suspect, value > 100 AS act FROM series""",
    "orders_x": """SELECT o_orderkey AS id, o_custkey AS actor, epoch_us(o_orderdate) // 86400000000 AS t_start,
  CASE WHEN o_orderstatus <> 'P' THEN max(epoch_us(l_shipdate) // 86400000000) END AS t_revert
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, o_custkey, o_orderdate, o_orderstatus""",
})


def _machine(source: str, name: str, live: str = "r.status = 'scored'") -> str:
    """Check SQL of the alarm machine: one recursive step per reading (1, 2, 3 debounce)."""
    return f"""SELECT user_id, tick, us, status, suspect, act, 'warming_up' AS prev, 'warming_up' AS state,
  CAST(0 AS BIGINT) AS ca, CAST(0 AS BIGINT) AS cs, CAST(0 AS BIGINT) AS q FROM {source} WHERE tick = 0
  UNION ALL SELECT user_id, tick, us, status, suspect, act, prev,
  CASE WHEN NOT live THEN 'unknown' WHEN ca >= 2 THEN 'act' WHEN base = 'act' THEN CASE WHEN q >= 3 THEN 'normal' ELSE 'act' END
    WHEN cs >= 1 THEN 'suspect' WHEN base = 'suspect' THEN CASE WHEN q >= 3 THEN 'normal' ELSE 'suspect' END ELSE 'normal' END AS state,
  ca, cs, q FROM (SELECT r.*, {live} AS live, m.state AS prev,
    CASE WHEN m.state IN ('warming_up', 'unknown') THEN 'normal' ELSE m.state END AS base,
    CASE WHEN {live} AND r.act THEN m.ca + 1 ELSE 0 END AS ca,
    CASE WHEN {live} AND (r.act OR r.suspect) THEN m.cs + 1 ELSE 0 END AS cs,
    CASE WHEN {live} AND NOT (r.act OR r.suspect) THEN m.q + 1 ELSE 0 END AS q
    FROM {name} m JOIN {source} r ON r.user_id = m.user_id AND r.tick = m.tick + 1)"""


# Patches of events to the document of their device: most write two leaves, some replace an object by a value,
# some delete an object or everything. A device that does not answer in the last slice keeps what it had.
SQL_VIEWS["twin_writes"] = f"""SELECT user_id, us, event_id, unnest(CASE WHEN k % 17 = 3 THEN ['features'] WHEN k % 10 = 0 OR k % 13 = 1 THEN ['features/' || event_type]
    ELSE ['features/' || event_type || '/value', 'features/' || event_type || '/k'] END) AS path,
  unnest(CASE WHEN k % 17 = 3 OR k % 10 = 0 THEN [NULL] WHEN k % 13 = 1 THEN [CAST(k AS VARCHAR)] ELSE [CAST(CAST(round(value * 10) AS BIGINT) AS VARCHAR), CAST(k AS VARCHAR)] END) AS value,
  (user_id + 2) % 7 <> 0 OR us < {T0_US + 20 * 2 * TICK_US} AS taken FROM ev"""
SQL_VIEWS["trace"] = _machine("readings", "trace")
SQL_VIEWS["zones"] = "SELECT user_id, event_type, us AS z0, us + 86400000000 AS z1 FROM readings WHERE k % 20 = 5"
SQL_VIEWS["readings_s"] = """SELECT r.*, coalesce((suspect OR act) AND EXISTS (SELECT 1 FROM zones z WHERE z.user_id = r.user_id
  AND z.event_type = r.event_type AND z.z0 <= r.us AND r.us < z.z1), false) AS held FROM readings r"""
SQL_VIEWS["trace_s"] = _machine("readings_s", "trace_s", "(r.status = 'scored' AND NOT r.held)")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(df: DataFrame, name: str) -> Column:
    """Epoch microseconds of a timestamp column, whatever the session time zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")
    return F.unix_micros(name)


def ev_columns(df: DataFrame) -> DataFrame:
    group = F.floor(F.col("user_id") / 16).cast("bigint")
    us = micros(df, "ts").alias("us")
    return df.select("event_id", us, "user_id", "event_type", "value", "props").select(
        "event_id", "us", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.concat(F.lit("R"), F.lpad(group.cast("string"), 6, "0")).alias("run_id"), group.alias("g"),
        F.floor((F.col("us") - T0_US) / TICK_US).cast("bigint").alias("tick"),
        F.concat(F.lit("link-"), F.col("event_type")).alias("entity"),
    )


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return ev_columns(table(spark, sf, "events"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return ev(spark, sf).groupBy("run_id", "g", "tick", "entity").agg(
        F.round(F.sum("value"), 2).alias("rate"), F.bool_and(F.col("k") % 25 != 0).alias("ok"),
        F.count(F.lit(1)).alias("n"), F.max("us").alias("us"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    total = ev(spark, sf).groupBy("run_id", "g").agg(
        F.sum("k").alias("sk"), F.count(F.lit(1)).alias("n_events"), (F.max("tick") + 1).alias("n_ticks")
    )
    faulty = F.col("g") % 4 == 3
    fault = F.when(F.col("sk") % 3 == 0, "degrade").when(F.col("sk") % 3 == 1, "admin_down").otherwise("flood")
    return total.select(
        "run_id", "g", F.when(F.col("g") % 2 == 0, "train").otherwise("test").alias("split"),
        F.when(faulty, "F").otherwise("C").alias("grp"),
        F.concat(F.lit("p"), (F.col("g") % 3).cast("string")).alias("profile"),
        F.when(faulty, fault).alias("fault"), F.when(faulty, 10 + F.col("sk") % 20).alias("inject"),
        F.when(faulty, 18 + F.col("sk") % 20 + F.col("n_events") % 7).alias("revert"),
        "n_ticks", "n_events",
    )


def n_entities(spark: SparkSession, sf: str) -> int:
    """How many entities a whole tick has."""
    return ev(spark, sf).select("entity").distinct().count()


def valid_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with the rate masked where it is not valid."""
    return cells(spark, sf).withColumn("rate", F.when(F.col("ok"), F.col("rate")))


def series(spark: SparkSession, sf: str) -> DataFrame:
    base = ev(spark, sf).drop("tick")
    chunk = S.range_chunk("us", S.even_width(base, ["user_id"], "us"))
    return S.row_index(base, ["user_id"], ["us", "event_id"], chunk, "tick", settle=True).select(
        "user_id", "event_id", "us", "value", "k", "event_type", "run_id", "tick"
    )


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return series(spark, sf).select(
        "user_id", "tick", "us", "k", "value", "event_type",
        F.when(F.col("tick") < 1, "warming_up").when(F.col("k") % 11 == 0, "unknown").otherwise("scored").alias("status"),
        (F.col("value") > 60).alias("suspect"), (F.col("value") > 100).alias("act"),
    )


def twin_patches(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, us, event_id, patch): JSON merge patches."""
    k, quoted = F.col("k").cast("string"), F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    value = F.round(F.col("value") * 10).cast("bigint").cast("string")
    inner = F.when(F.col("k") % 10 == 0, F.lit("null")).when(F.col("k") % 13 == 1, k).otherwise(F.concat(F.lit('{"value": '), value, F.lit(', "k": '), k, F.lit("}")))
    patch = F.when(F.col("k") % 17 == 3, F.lit('{"features": null}')).otherwise(F.concat(F.lit('{"features": {'), quoted, F.lit(": "), inner, F.lit("}}")))
    return ev(spark, sf).select("user_id", "us", "event_id", patch.alias("patch"))


def interventions(spark: SparkSession, sf: str) -> DataFrame:
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    day = 86400 * 10**6
    closed = items.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.max(F.floor(micros(items, "l_shipdate") / day)).cast("bigint").alias("t_close")
    )
    opened = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("actor"),
        F.floor(micros(orders, "o_orderdate") / day).cast("bigint").alias("t_start"), "o_orderstatus",
    )
    return opened.join(closed, "id", "left").select(
        "id", "actor", "t_start", F.when(F.col("o_orderstatus") != "P", F.col("t_close")).alias("t_revert")
    )
