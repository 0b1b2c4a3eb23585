"""Statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share; NULL when nothing was counted."""
    n = F.when(n > 0, n.cast("double"))
    share, z2 = k / n, z * z
    centre = share + z2 / (2 * n)
    half = z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))
    scale = 1 + z2 / n
    low, high = (centre - half) / scale, (centre + half) / scale
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), low)), F.when(n.isNotNull(), F.least(F.lit(1.0), high))


def ln_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series, shifted by 8 so that small n are exact to 1e-12."""
    x = n.cast("double") + 8
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7) + 1 / (1188 * x**9)
    shift = F.lit(0.0)
    for i in range(1, 9):
        shift = shift + F.log(n.cast("double") + i)
    return series - shift


def fisher_two_sided(tables: DataFrame, keys: list[str], a: str, b: str, c: str, d: str) -> DataFrame:
    """Exact two-sided p of 2x2 tables: every table is spread over its possible corner counts,
    and the terms no larger than the observed one are summed per key."""
    row, col, n = F.col(a) + F.col(b), F.col(a) + F.col(c), F.col(a) + F.col(b) + F.col(c) + F.col(d)
    sized = tables.select(*keys, F.col(a).alias("_a"), row.alias("_r"), col.alias("_c"), n.alias("_n"))
    lo = F.greatest(F.lit(0).cast("bigint"), F.col("_c") - (F.col("_n") - F.col("_r")))
    hi = F.least(F.col("_r"), F.col("_c"))
    # Two levels keep each array short; every possible corner count is a term.
    blocks = sized.withColumns({"_hi": hi, "_b": F.explode(F.sequence(lo, F.greatest(lo, hi), F.lit(65536).cast("bigint")))})
    spread = blocks.withColumn("_k", F.explode(F.sequence(F.col("_b"), F.least(F.col("_b") + 65535, F.greatest(F.col("_hi"), F.col("_b"))))))

    def choose(total: Column, part: Column) -> Column:
        return ln_factorial(total) - ln_factorial(part) - ln_factorial(total - part)

    def weight(k: Column) -> Column:
        return choose(F.col("_r"), k) + choose(F.col("_n") - F.col("_r"), F.col("_c") - k) - choose(F.col("_n"), F.col("_c"))

    # All terms sum to one; dividing by their sum takes the rounding of the logarithms out.
    terms = spread.select(*keys, F.exp(weight(F.col("_k"))).alias("_p"), (weight(F.col("_k")) <= weight(F.col("_a")) + 1e-9).alias("_in"))
    share = F.sum(F.when(F.col("_in"), F.col("_p"))) / F.sum("_p")
    return terms.groupBy(*keys).agg(F.least(F.lit(1.0), share).alias("p"))


def poisson_upper(k: Column, alpha: float = 0.05) -> Column:
    """One-sided upper bound of a Poisson mean: P(X <= k) = alpha, by bisection of the logarithm of
    the sum. The bound lies above k, where the terms fall from k downwards, so the sum is the term
    at k times a falling series and nothing leaves double range, whatever k is."""
    k = k.cast("bigint")
    falling = F.when(k > 0, F.sequence(k, F.lit(1).cast("bigint"), F.lit(-1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def log_cdf(rate: Column) -> Column:
        series = F.aggregate(falling, one, lambda s, i: F.struct((s["term"] * i / rate).alias("term"), (s["total"] + s["term"] * i / rate).alias("total")), lambda s: s["total"])
        return k * F.log(rate) - rate - ln_factorial(k) + F.log(series)

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        above = log_cdf(mid) > math.log(alpha)
        return F.struct(F.when(above, mid).otherwise(acc["lo"]).alias("lo"), F.when(above, acc["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(k.cast("double").alias("lo"), F.greatest(F.lit(10.0), 10.0 * (k + 1)).alias("hi"))
    return F.when(k.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, halve, lambda acc: acc["hi"]))


def log_separation(value: Column, floor: float = 1e-3) -> Column:
    return F.log10(F.greatest(value, F.lit(floor)))


def applied_mbps(baseline: Column, factor: Column) -> Column:
    """Bandwidth a degrade sets, never below 1 Mbps."""
    return F.greatest(F.lit(1.0), baseline * (1 - factor))


def saturation_ratio(offered_bytes: Column, baseline: Column, factor: Column) -> Column:
    return offered_bytes / (applied_mbps(baseline, factor) * 1e6 / 8)


def fill_seconds(load: Column, capacity: Column, packets: int = 1000, packet_bytes: int = 1512) -> Column:
    """Time until a queue is full; NULL without excess load."""
    excess = load - capacity
    return F.when(excess > 1e-9, F.lit(packets * packet_bytes * 8.0) / (excess * 1e6))


def tolerant_equal(a: Column, b: Column, pct: float = 5.0, absolute: float = 1.0) -> Column:
    """Equal, or closer than ``absolute``, or closer than ``pct`` percent of ``a``."""
    gap = F.abs(a - b)
    return F.coalesce(a == b, F.lit(False)) | F.coalesce(gap < absolute, F.lit(False)) | F.coalesce(
        (a != 0) & (gap / F.abs(a) < pct / 100.0), F.lit(False)
    ) | (a.isNull() & b.isNull())


def mbps(bytes_per_second: Column) -> Column:
    return bytes_per_second * 8.0 / 1e6
