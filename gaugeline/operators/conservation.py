"""Flow balance per switch from an incidence table (switch, column, side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def residuals(cells: DataFrame, incidence: DataFrame, keys: list[str], column: str, value: str, floor: float) -> DataFrame:
    """r = (in - out) / max(in, floor) per key and switch; NULL when a needed value is missing.
    The needed number of columns comes from the incidence table itself."""
    needed = incidence.groupBy("switch").agg(F.count(F.lit(1)).alias("_need"))
    listed = incidence.join(needed, "switch")
    rows = cells.join(listed, column)
    inflow, outflow = (F.sum(F.when(F.col("side") == side, F.col(value)).otherwise(0.0)) for side in ("in", "out"))
    sums = rows.groupBy(*keys, "switch").agg(
        inflow.alias("_in"), outflow.alias("_out"), (F.count(value) == F.max("_need")).alias("_ok")
    )
    r = (F.col("_in") - F.col("_out")) / F.greatest(F.col("_in"), F.lit(floor))
    return sums.select(*keys, "switch", F.when(F.col("_ok"), r).alias("r"))


def worst(per_switch: DataFrame, keys: list[str], n_switches: int | Column) -> DataFrame:
    """Largest residual and its switch (first by name on a tie) when every switch can be judged."""
    best = F.min(F.when(F.col("r").isNotNull(), F.struct((-F.col("r")).alias("neg"), "switch")))
    out = per_switch.groupBy(*keys).agg((F.count("r") == n_switches).alias("judgeable"), best.alias("_b"))
    return out.select(
        *keys, "judgeable", F.when(F.col("judgeable"), -F.col("_b.neg")).alias("r_max"),
        F.when(F.col("judgeable"), F.col("_b.switch")).alias("argmax_switch"),
    )


def alarm(r_max: Column, threshold: Column) -> Column:
    """One-sided and strict."""
    return F.coalesce(r_max > threshold, F.lit(False))
