"""Normal-range envelope: fit min/max on train rows, count and weigh what leaves it.

All functions work on the long table (run, tick, column, value), so one grouped pass serves
any number of columns; the bounds table has one row per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_FLOOR = 1.0


def finite(value: Column) -> Column:
    """NULL for NULL, NaN and infinities (NaN would compare above every number)."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def fit_bounds(cells: DataFrame, column: str, value: str, extra_keys: list[str] | None = None) -> DataFrame:
    keys = [*(extra_keys or []), column]
    clean = cells.withColumn("_v", finite(F.col(value))).where(F.col("_v").isNotNull())
    return clean.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))


def violation(value: Column, lo: Column, hi: Column) -> Column:
    """Strictly outside; a missing value is no violation."""
    return F.coalesce((value < lo) | (value > hi), F.lit(False))


def overshoot(value: Column, lo: Column, hi: Column, floor: float = RANGE_FLOOR) -> Column:
    """Distance outside the range, in units of the range."""
    return F.greatest(lo - value, value - hi, F.lit(0.0)) / F.greatest(hi - lo, F.lit(floor))


def score(
    cells: DataFrame, bounds: DataFrame, keys: list[str], column: str, value: str,
    n_columns: int | Column, families: dict[str, list[str]] | None = None, floor: float = RANGE_FLOOR,
) -> DataFrame:
    """Per key: k (violations), excess, judgeable (all model columns finite) and one count per
    family, from a single grouped pass. Bounds have one row per model column, so the join side
    is as small as the model; AQE picks the strategy from its measured size."""
    joined = cells.join(bounds, [c for c in bounds.columns if c not in ("lo", "hi")])
    v = finite(F.col(value))
    out = violation(v, F.col("lo"), F.col("hi"))
    needed = F.lit(n_columns) if isinstance(n_columns, int) else n_columns
    return joined.groupBy(*keys).agg(
        F.count_if(out).alias("k"),
        *[F.count_if(out & F.col(column).isin(members)).alias(f"k_{name}") for name, members in (families or {}).items()],
        F.sum(F.coalesce(overshoot(v, F.col("lo"), F.col("hi"), floor), F.lit(0.0))).alias("excess"),
        (F.count(v) == needed).alias("judgeable"),
    )


def decide(scores: DataFrame, e_limit: Column, k1: Column, k2: Column) -> DataFrame:
    """suspect on excess, act on either family count; equality never alarms, unjudgeable never alarms."""
    return scores.withColumn("suspect", F.col("judgeable") & (F.col("excess") > e_limit)).withColumn(
        "act", F.col("judgeable") & ((F.col("k_indicator") > k1) | (F.col("k_rate") > k2))
    )


def bounds_without(cells: DataFrame, fold: str, column: str, value: str) -> DataFrame:
    """Extremes per (fold, column) over all other folds, from one row per fold and column. A
    column that no other fold measured has none."""
    per_fold = fit_bounds(cells, column, value, [fold])
    by_column = Window.partitionBy(column).orderBy(fold)
    left = by_column.rowsBetween(Window.unboundedPreceding, -1)
    right = by_column.rowsBetween(1, Window.unboundedFollowing)
    others = per_fold.select(
        fold, column,
        F.least(F.min("lo").over(left), F.min("lo").over(right)).alias("lo"),
        F.greatest(F.max("hi").over(left), F.max("hi").over(right)).alias("hi"),
    )
    return others.where(F.col("lo").isNotNull())


def extremes_without(cells: DataFrame, fold: str, column: str, value: str) -> DataFrame:
    """Upper extreme with one fold left out, and how far it falls below the full one."""
    rest = bounds_without(cells, fold, column, value).where(F.col("hi").isNotNull())
    full = fit_bounds(cells, column, value).select(column, F.col("hi").alias("_top"))
    return rest.join(full, column).select(fold, column, "hi", (F.col("_top") - F.col("hi")).alias("drop"))


def heldout_scores(cells: DataFrame, keys: list[str], fold: str, column: str, value: str, n_columns: int) -> DataFrame:
    """Score every row against bounds fitted on all other folds. Fold bounds come from per-fold
    extremes (folds x columns rows), never from a second pass over the rows per fold."""
    bounds = bounds_without(cells, fold, column, value)
    return score(cells, bounds, [fold, *keys], column, value, n_columns)


def column_audit(cells: DataFrame, column: str, value: str, n_rows: Column | None = None) -> DataFrame:
    """Null share, distinct count, constant flag and bounds per column, without labels."""
    v = finite(F.col(value))
    distinct = cells.select(column, v.alias("_v")).where("_v is not null").groupBy(column, "_v").agg(F.count(F.lit(1)).alias("_c"))
    spread = distinct.groupBy(column).agg(
        F.count(F.lit(1)).alias("n_distinct"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.sum("_c").alias("n_valid")
    )
    size = cells.groupBy(column).agg(F.count(F.lit(1)).alias("n_cells"))
    joined = size.join(spread, column, "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    return joined.withColumn("pct_null", 100.0 * (F.col("n_cells") - F.col("n_valid")) / F.col("n_cells"))


def owner_of_max(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The row that sets the maximum; the first in ``order`` wins a tie."""
    best = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min(F.struct((-F.col(value)).alias("_neg"), *order)).alias("_best")
    )
    return best.select(*keys, (-F.col("_best._neg")).alias(value), *[F.col(f"_best.{c}").alias(c) for c in order])


REQUIRED_FAMILIES = ("primary", "indicator", "rate_shared", "loss_only")


def contract_violations(columns: DataFrame, families: DataFrame, bounds: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Where a model's tables break their contract: (keys, rule, name). Columns are unique; bounds exist
    for all of them and no other, are finite and lo <= hi; the required families exist and have a
    threshold; the primary family is the columns; indicator and rate families are disjoint and together the
    columns; no family has an unknown column. ``keys`` tell models apart."""
    cols, fams = columns.select(*keys, "column").distinct(), families.select(*keys, "family", "column").distinct()
    named = lambda df, rule, name: df.select(*keys, F.lit(rule).alias("rule"), F.col(name).alias("name"))
    low, high = F.col("lo").cast("double"), F.col("hi").cast("double")
    bad = low.isNull() | high.isNull() | F.isnan(low) | F.isnan(high) | (F.abs(low) == float("inf")) | (F.abs(high) == float("inf")) | (low > high)
    models = columns.select(*keys).distinct()
    wanted = models.select("*", F.explode(F.array(*map(F.lit, REQUIRED_FAMILIES))).alias("family"))
    family = lambda n: fams.where(F.col("family") == n).select(*keys, "column")
    split = family("indicator").unionByName(family("rate_shared")).distinct()
    in_model = [*keys, "column"]
    parts = [
        named(columns.groupBy(*in_model).count().where("count > 1"), "duplicate column", "column"),
        named(cols.join(bounds.select(*in_model), in_model, "left_anti"), "no bounds", "column"),
        named(bounds.join(cols, in_model, "left_anti").select(*in_model).distinct(), "bounds of no column", "column"),
        named(bounds.where(F.coalesce(bad, F.lit(True))), "bad bounds", "column"),
        named(wanted.join(fams, [*keys, "family"], "left_anti"), "no family", "family"),
        named(fams.select(*keys, "family").distinct().join(thresholds.where("threshold is not null"), [*keys, "family"], "left_anti"), "no threshold", "family"),
        named(fams.join(cols, in_model, "left_anti").withColumn("x", F.concat_ws(":", "family", "column")), "unknown column", "x"),
        named(cols.join(family("primary"), in_model, "left_anti"), "not in primary", "column"),
        named(family("indicator").join(family("rate_shared"), in_model, "left_semi"), "in both parts", "column"),
        named(cols.join(split, in_model, "left_anti"), "in no part", "column"),
    ]
    return reduce(DataFrame.unionByName, parts)
