"""Latency of commands and trials: stage times, layers, budgets, jitter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import quantiles as Q
from gaugeline.operators import scan as S



def summarize(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, p50, p95, p99, max, min with the nearest-rank rule for the tails."""
    basics = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min")
    )
    ranks = Q.quantiles(df, keys, value, {"p50": ("middle", 0.5), "p95": ("nearest", 0.95), "p99": ("nearest", 0.99)})
    return basics.join(ranks, keys) if keys else basics.join(ranks)


def command_stages(events: DataFrame) -> DataFrame:
    """First time per command (cid) and stage, one column per stage."""
    known = events.where("cid is not null and cid <> '-' and stage not in ('detect', 'push')")
    stages = ("click", "ditto_response", "agent_receive", "exec_done", "ui", "ui_resync", "ui_timeout")
    return known.groupBy("cid").agg(
        F.max_by("target", F.when(F.col("target") != "-", F.col("us"))).alias("target"), F.max_by("subject", F.when(F.col("subject").isNotNull(), F.col("us"))).alias("subject"),
        F.max_by("expect", F.when(F.col("expect").isNotNull(), F.col("us"))).alias("expect"), F.min("us").alias("first_us"),
        *[F.min(F.when(F.col("stage") == s, F.col("us"))).alias(s) for s in stages],
    )


def attach_observed(commands: DataFrame, observed: DataFrame, window_us: int) -> DataFrame:
    """Give each detect/push line to the latest earlier command on its target that expects its
    state, was executed at most ``window_us`` before and is not shown yet; a command keeps its
    first line per stage. Candidates meet on (target, time bucket of the window's length)."""
    bucket = lambda c: F.floor(c / F.lit(window_us)).cast("bigint")
    shown = F.coalesce("ui", "ui_resync", "ui_timeout")
    done = commands.where("exec_done is not null").select(
        "cid", F.col("target").alias("_t"), "expect", "exec_done", shown.alias("_shown"), "first_us",
        F.explode(F.array(bucket(F.col("exec_done")), bucket(F.col("exec_done")) + 1)).alias("_b"),
    )
    lines = observed.select("target", "stage", "us", "detail", bucket(F.col("us")).alias("_lb"))
    pairs = lines.join(done, (F.col("target") == F.col("_t")) & (F.col("_lb") == F.col("_b")))
    age = F.col("us") - F.col("exec_done")
    fits = (age >= 0) & (age <= window_us) & (F.col("_shown").isNull() | (F.col("us") <= F.col("_shown")))
    fits = fits & (F.col("expect").isNull() | F.col("detail").eqNullSafe(F.col("expect")))
    best = pairs.where(fits).groupBy("target", "stage", "us", "detail").agg(F.max(F.struct("first_us", "cid")).alias("_w"))
    seen = best.groupBy(F.col("_w.cid").alias("cid")).agg(*[F.min(F.when(F.col("stage") == s, F.col("us"))).alias(s) for s in ("detect", "push")])
    return commands.join(seen, "cid", "left")


def command_figures(commands: DataFrame) -> DataFrame:
    """Durations in ms between stages, and the first missing stage."""
    ms = lambda a, b: F.round((b - a) / 1000.0, 0).cast("bigint")
    c = F.col
    ui = F.coalesce("ui_resync", "ui_timeout", "ui")
    note = (
        F.when(c("ui_resync").isNotNull(), "RESYNC").when(c("ui_timeout").isNotNull(), "TIMEOUT").when(c("agent_receive").isNull(), "missing AGENT RECEIVE")
        .when(c("exec_done").isNull(), "missing EXECUTE_DONE").when(c("detect").isNull(), "missing STATE_DETECTED").when(c("push").isNull(), "missing STATE_PUSHED")
        .when(ui.isNull(), "missing UI reflection").otherwise("")
    )
    return commands.select(
        "cid", "target", "subject", ms(c("click"), c("agent_receive")).alias("route_ms"), ms(c("agent_receive"), c("exec_done")).alias("exec_ms"), ms(c("exec_done"), c("detect")).alias("detect_ms"),
        ms(c("detect"), c("push")).alias("push_ms"), ms(F.coalesce("click", "exec_done"), ui).alias("total_ms"), note.alias("note"),
    )


def intervals_ms(df: DataFrame, keys: list[str], order: list[str], chunk: Column, at_us: str) -> DataFrame:
    out = S.scan(df, keys, order, chunk, _p=S.previous(F.col(at_us)))
    return out.withColumn("dt_ms", (F.col(at_us) - F.col("_p")) / 1000.0).drop("_p")


def second_half_slope(df: DataFrame, keys: list[str], index: str, t: str, y: str) -> DataFrame:
    """Least-squares slope over the second half of each series, with delta and peak. Fewer than
    four samples give none."""
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max_by(y, index).alias("_last"), F.min_by(y, index).alias("_first"), F.max(y).alias("peak"))
    rows = df.join(size, keys)
    slope = F.regr_slope(F.when(F.col(index) >= F.floor(F.col("_n") / 2), F.col(y)), F.col(t))
    out = rows.groupBy(*keys).agg(F.max("_n").alias("n"), slope.alias("slope"), F.max(F.col("_last") - F.col("_first")).alias("delta"), F.max("peak").alias("peak"))
    enough = F.col("n") >= 4
    return out.select(*keys, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("slope", "delta", "peak")])
