"""Where lost traffic went: balance against its pre-fault bias, split into drops and backlog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def account(rows: DataFrame, keys: list[str], noise_factor: float = 3.0, closure_tolerance: float = 0.25, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Per probe from ticks with phase, bal (in - out), drops, packets, bytes. The bias and packet
    size come from the settled ticks before the fault, the noise is their largest deviation."""
    pre = (F.col("phase") == "pre") & (F.col("tick") >= 2)
    base = rows.where(pre).groupBy(*keys).agg(
        F.avg("bal").alias("bias"), (F.sum("bytes") / F.sum("packets")).alias("mpb"), F.min("bal").alias("_lo"), F.max("bal").alias("_hi")
    )
    base = base.withColumn("noise", F.greatest(F.col("bias") - F.col("_lo"), F.col("_hi") - F.col("bias")))
    off = F.col("bal") - F.col("bias")
    window = rows.where("phase = 'fault'").join(base, keys).groupBy(*keys, "noise", "mpb").agg(
        F.sum(off).alias("missing"), F.count(F.lit(1)).alias("n_ticks"), F.sum("drops").alias("drops"), F.max(off).alias("backlog")
    )
    some = F.col("missing") > 0
    out = window.withColumns({
        "share_leaf": F.when(some, F.col("drops") * F.col("mpb") / F.col("missing")), "share_queue": F.when(some, F.col("backlog") / F.col("missing")),
    }).withColumn("closure", F.col("share_leaf") + F.col("share_queue"))
    leaf, queue = F.col("share_leaf"), F.col("share_queue")
    kind = (
        F.when(F.col("missing") <= noise_factor * F.col("noise") * F.sqrt(F.greatest(F.col("n_ticks"), F.lit(1))), "NO_MISSING")
        .when(F.col("closure").isNull() | (F.abs(F.col("closure") - 1) > closure_tolerance), "UNEXPLAINED")
        .when((leaf < low) & (queue >= high), "QUEUE_ONLY").when(leaf >= high, "DROP_DOMINANT")
        .when((leaf >= low) & (queue >= low), "QUEUE_THEN_DROP").otherwise("UNEXPLAINED")
    )
    return out.withColumn("class", kind).drop("mpb", "backlog")


def conclude(probes: DataFrame, keys: list[str], finding: str, at_least: int = 2) -> DataFrame:
    """A finding counts when every repeat shows it; one repeat proves nothing."""
    n, every, some = F.count(F.lit(1)), F.bool_and(finding), F.bool_or(finding)
    kind = F.when(n < at_least, "too_few").when(every, "confirmed").when(some, "mixed").otherwise("refuted")
    return probes.groupBy(*keys).agg(n.alias("n_repeats"), every.alias("all_missing"), some.alias("any_missing"), kind.alias("conclusion"))
