"""Exact order statistics without one task per group.

Ties are folded first. A key with more distinct values than a task should hold is cut into value buckets
at approximate quantiles, and buckets that are still too large are cut again, so the largest one is
below a number of rows at any size and any distribution. Only buckets that hold a wanted rank are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators.scan import join_null_safe
from gaugeline.session import cut_lineage

ROWS_PER_BUCKET = 200_000  # distinct values that one task sorts
FAN = 128  # parts of a bucket that is cut

# Rank rules: position(s) counted from 0 in the sorted values of a key with n values.
RULES = {
    "nearest": lambda q, n: (F.greatest(F.ceil(F.round(q * n, 9)) - 1, F.lit(0)),) * 2,
    "round": lambda q, n: (F.bround(q * (n - 1), 0),) * 2,
    "floor": lambda q, n: (F.least(F.floor(F.round(q * n, 9)), n - 1),) * 2,
    "floor_last": lambda q, n: (F.floor(F.round(q * (n - 1), 9)),) * 2,
    "linear": lambda q, n: (F.floor(q * (n - 1)), F.ceil(q * (n - 1))),
    "upper_median": lambda q, n: (F.floor(n / 2),) * 2,
    "middle": lambda q, n: (F.floor((n - 1) / 2), F.floor(n / 2)),
}


def with_buckets(folded: DataFrame, keys: list[str], value: str, rows: int | None = None) -> DataFrame:
    """Add ``_bucket``, which never falls as ``value`` grows, with at most ``rows`` rows (distinct values) of a
    key in one bucket. Rounds grow with the logarithm of the largest key to base :data:`FAN`."""
    rows = rows or ROWS_PER_BUCKET
    grid = [i / FAN for i in range(1, FAN)]
    group, placed, first = [*keys, "_bucket"], folded.withColumn("_bucket", F.lit(0).cast("bigint")), True
    while True:
        large = cut_lineage(placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).drop("_n"))
        if large.isEmpty():
            return placed
        if first:
            placed, first = cut_lineage(placed), False  # ties are folded once, whatever the rounds
        cuts = join_null_safe(placed, large, group, "inner").groupBy(*group).agg(F.array_distinct(F.percentile_approx(value, grid, 10000)).alias("_cuts"))
        told = join_null_safe(placed, cut_lineage(cuts), group)
        below = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))
        placed = told.withColumn("_bucket", F.col("_bucket") * FAN + F.when(F.col("_cuts").isNull(), 0).otherwise(below)).drop("_cuts")


def quantiles(
    df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[str, float]],
    rows: int | None = None, count_as: str | None = None,
) -> DataFrame:
    """One row per key with the wanted quantiles, each given as ``(rule, q)``. NULL and NaN
    values are left out; keys without values are absent."""
    number = F.col(value).cast("double")
    clean = df.select(*keys, number.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if not keys:
        keys, clean = ["_all"], clean.withColumn("_all", F.lit(0))
    folded = clean.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_w"))
    placed = with_buckets(folded, keys, "_v", rows)

    sizes = placed.groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_bw"))
    by_key = Window.partitionBy(*keys)
    sizes = sizes.select(
        *keys, "_bucket", "_bw",
        F.coalesce(F.sum("_bw").over(by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_bw").over(by_key).alias("_n"),
    )
    ranks = []
    for name, (rule, q) in wanted.items():
        low, high = RULES[rule](F.lit(float(q)), F.col("_n"))
        ranks.append(F.struct(F.lit(name).alias("name"), F.lit(0).alias("side"), low.cast("bigint").alias("rank")))
        ranks.append(F.struct(F.lit(name).alias("name"), F.lit(1).alias("side"), high.cast("bigint").alias("rank")))
    hits = (
        sizes.withColumn("_r", F.explode(F.array(*ranks)))
        .where((F.col("_r.rank") >= F.col("_before")) & (F.col("_r.rank") < F.col("_before") + F.col("_bw")))
        .select(*keys, "_bucket", "_n", "_r.name", "_r.side", (F.col("_r.rank") - F.col("_before")).alias("_at"))
    )
    needed = hits.groupBy(*keys, "_bucket").agg(F.max("_n").alias("_n"), F.collect_list(F.struct("name", "side", "_at")).alias("_hits"))
    upto = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        join_null_safe(placed, needed, [*keys, "_bucket"], "inner")
        .withColumn("_upto", F.sum("_w").over(upto))
        .withColumn("_h", F.explode(F.filter("_hits", lambda h: (h["_at"] < F.col("_upto")) & (h["_at"] >= F.col("_upto") - F.col("_w")))))
    )
    columns: list[Column] = []
    for name, (rule, q) in wanted.items():
        low = F.max(F.when((F.col("_h.name") == name) & (F.col("_h.side") == 0), F.col("_v")))
        high = F.max(F.when((F.col("_h.name") == name) & (F.col("_h.side") == 1), F.col("_v")))
        if rule == "linear":
            at = F.lit(float(q)) * (F.max("_n") - 1)
            columns.append((low + (high - low) * (at - F.floor(at))).alias(name))
        elif rule == "middle":
            columns.append(((low + high) / 2).alias(name))
        else:
            columns.append(low.alias(name))
    if count_as:
        columns.append(F.max("_n").alias(count_as))
    return picked.groupBy(*keys).agg(*columns).drop("_all")


def ranked_sums(df: DataFrame, keys: list[str], value: str, side: str) -> DataFrame:
    """Rank AUC per key from tie-folded counts: P(positive > negative) + P(tie)/2, where
    ``side`` is the boolean class column; ``n_at_or_above`` counts the pairs whose positive is not
    below the negative."""
    clean = df.select(*keys, F.col(value).cast("double").alias("_v"), F.col(side).alias("_y")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v") & F.col("_y").isNotNull()
    )
    folded = clean.groupBy(*keys, "_v").agg(
        F.count_if(F.col("_y")).alias("_p"), F.count_if(~F.col("_y")).alias("_q")
    )
    if not keys:
        keys, folded = ["_all"], folded.withColumn("_all", F.lit(0))
    placed = with_buckets(folded, keys, "_v")
    past = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy(*keys, "_bucket").agg(F.sum("_q").alias("_bq"))
    base = base.select(*keys, "_bucket", F.coalesce(F.sum("_bq").over(past), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_base") + F.coalesce(F.sum("_q").over(inside), F.lit(0))
    scored = join_null_safe(placed, base, [*keys, "_bucket"], "inner").withColumn("_below", below)
    won = F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2))
    return scored.groupBy(*keys).agg(
        F.try_divide(won, (F.sum("_p") * F.sum("_q")).cast("double")).alias("auc"),
        F.sum("_p").alias("n_positive"), F.sum("_q").alias("n_negative"),
        F.sum(F.col("_p") * (F.col("_below") + F.col("_q"))).alias("n_at_or_above"),
    )
