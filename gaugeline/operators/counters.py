"""Deltas, rolling means, counter rates, queue intervals and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators import scan as S


def delta(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: str, name: str = "delta") -> DataFrame:
    """x[t] - x[t-1] inside a key; NULL on the first row or when either side is missing."""
    out = S.scan(df, keys, order, chunk, _p=S.previous(F.col(value)))
    return out.withColumn(name, F.col(value) - F.col("_p")).drop("_p")


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: str, window: int, name: str) -> DataFrame:
    """Mean of the ``window`` rows before the current one; NULL until all of them are measured."""
    placed = S.row_index(df, keys, order, chunk, "_idx")
    spread, parts, own = S.lookback(placed, keys, "_idx", window)
    frame = Window.partitionBy(*parts).orderBy("_idx").rowsBetween(-window, -1)
    full = F.count(value).over(frame) == window
    out = spread.withColumn(name, F.when(full, F.avg(value).over(frame))).where(own)
    return out.drop("_idx", "_home", "_range")


def steady(df: DataFrame, keys: list[str], index: str, value: str, n: int, tolerance: float, minimum: float, name: str = "steady") -> DataFrame:
    """True where the last ``n`` values spread less than ``tolerance`` and reach ``minimum``."""
    spread, parts, own = S.lookback(df, keys, index, n - 1)
    frame = Window.partitionBy(*parts).orderBy(index).rowsBetween(-(n - 1), 0)
    top, low = F.max(value).over(frame), F.min(value).over(frame)
    enough = F.count(value).over(frame) == n
    flag = enough & (top - low < tolerance) & (top >= minimum)
    return spread.withColumn(name, flag).where(own).drop("_home", "_range")


def counter_rates(df: DataFrame, keys: list[str], order: list[str], chunk: Column, counters: list[str], seconds: str) -> DataFrame:
    """Per counter a rate per second, and for the row a validity flag with its reason. An invalid
    row keeps rate 0.0; the flag tells that it was not measured."""
    prev = S.previous(F.struct(F.col(seconds).alias("t"), *counters))
    out = S.scan(df, keys, order, chunk, _p=prev)
    dt = F.col(seconds) - F.col("_p.t")
    deltas = {c: F.col(c) - F.col(f"_p.{c}") for c in counters}
    missing = F.greatest(*[d.isNull() for d in deltas.values()], F.lit(False))
    fell = F.greatest(*[F.coalesce(d < 0, F.lit(False)) for d in deltas.values()], F.lit(False))
    reason = (
        F.when(F.col("_p").isNull() | F.col("_p.t").isNull(), "warmup")
        .when(dt <= 0, "nonpositive_dt").when(missing, "invalid_counter").when(fell, "counter_reset").otherwise("ok")
    )
    rates = {f"{c}_rate": F.when((dt > 0) & (d >= 0), d / dt).otherwise(0.0) for c, d in deltas.items()}
    out = out.withColumns({**rates, "rate_reason": reason})
    return out.withColumn("rate_valid", F.col("rate_reason") == "ok").drop("_p")


def queue_interval(df: DataFrame, keys: list[str], order: list[str], chunk: Column, queues: str) -> DataFrame:
    """Loss over one interval from cumulative queue counters. ``queues`` is an array of
    struct(name, sig, drops, packets) sorted by name, NULL counters meaning an unreadable queue."""
    out = S.scan(df, keys, order, chunk, _p=S.previous(F.col(queues)))
    pairs = F.arrays_zip(F.col(queues).alias("now"), F.col("_p").alias("old"))
    names = lambda column: F.transform(column, lambda q: q["name"])
    unreadable = F.exists(queues, lambda q: q["drops"].isNull() | q["packets"].isNull())
    broken = F.exists(
        pairs,
        lambda z: z["old"]["drops"].isNull() | z["old"]["packets"].isNull() | ~z["now"]["sig"].eqNullSafe(z["old"]["sig"])
        | (z["now"]["drops"] < z["old"]["drops"]) | (z["now"]["packets"] < z["old"]["packets"]),
    )
    reason = (
        F.when(unreadable, "unavailable")
        .when(F.col("_p").isNull() | ~names(queues).eqNullSafe(names(F.col("_p"))), "warmup")
        .when(broken, "counter_reset").otherwise("ok")
    )
    spread = lambda f: F.aggregate(
        pairs, F.lit(0).cast("bigint"), lambda acc, z: acc + (z["now"][f] - z["old"][f]).cast("bigint")
    )
    out = out.withColumn("reason", reason)
    ok = F.col("reason") == "ok"
    out = out.withColumn("drop_delta", F.when(ok, spread("drops"))).withColumn("sent_delta", F.when(ok, spread("packets")))
    total = F.col("drop_delta") + F.col("sent_delta")
    loss = F.when(ok, F.when(total > 0, F.round(100.0 * F.col("drop_delta") / total, 3)).otherwise(0.0))
    return out.withColumn("loss_pct", loss).drop("_p")


def fabricated_zeros(df: DataFrame, keys: list[str], order: list[str], chunk: Column, counter: str, rate: str) -> DataFrame:
    """Rows that report rate 0 although the counter moved, or on the first row of a key."""
    out = S.scan(df, keys, order, chunk, _p=S.previous(F.col(counter)), _seen=S.count(before=True))
    moved = F.col(counter) - F.col("_p")
    kind = F.when((F.col("_seen") == 0) & (F.col(rate) == 0), "warmup_no_prev").when(
        (F.col(rate) == 0) & (moved > 0), "zero_but_counter_advanced"
    )
    return out.withColumn("kind", kind).withColumn("counter_delta", moved).where(F.col("kind").isNotNull()).drop("_p", "_seen")


def changes(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: str, tolerance: float, refresh: int | None = None, cycle: str | None = None) -> DataFrame:
    """Rows to re-send: first of a key, or moved by ``tolerance`` or more against the row before,
    or every ``refresh``-th cycle."""
    out = S.scan(df, keys, order, chunk, _p=S.previous(F.struct(F.col(value).alias("v"))))
    same = F.when(F.col("_p.v").isNull() | F.col(value).isNull(), F.col("_p.v").eqNullSafe(F.col(value))).otherwise(
        F.abs(F.col(value) - F.col("_p.v")) < tolerance
    )
    send = F.col("_p").isNull() | ~same
    if refresh and cycle:
        send = send | (F.col(cycle) % refresh == 0)
    return out.where(send).drop("_p")
