"""Missing data, feature audit and run acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import stats
from gaugeline.operators import quantiles as Q


def missing_by(cells: DataFrame, keys: list[str], row_keys: list[str], value: str) -> DataFrame:
    """Missing share by cell and by row, with the Wilson interval of the cell share."""
    gap = F.col(value).isNull()
    rows = cells.groupBy(*keys, *row_keys).agg(F.count_if(gap).alias("_m"), F.count(F.lit(1)).alias("_n"))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_m") > 0).alias("rows_missing"),
        F.sum("_n").alias("n_cells"), F.sum("_m").alias("cells_missing"),
    )
    low, high = stats.wilson(F.col("cells_missing"), F.col("n_cells"))
    return out.withColumns({
        "pct_rows": 100.0 * F.col("rows_missing") / F.col("n_rows"), "pct_cells": 100.0 * F.col("cells_missing") / F.col("n_cells"),
        "ci_low": 100 * low, "ci_high": 100 * high,
    })


def mask_invalid(df: DataFrame, rates: list[str], flag: str) -> DataFrame:
    """NULL every rate whose flag is not exactly true, a missing flag included."""
    valid = F.col(flag).eqNullSafe(F.lit(True))
    return df.withColumns({r: F.when(valid, F.col(r)) for r in rates})


def two_by_two(cells: DataFrame, keys: list[str], fault: str, value: str) -> DataFrame:
    """Counts a, b, c, d of fault x missing."""
    gap, bad = F.col(value).isNull(), F.col(fault)
    return cells.groupBy(*keys).agg(
        F.count_if(bad & gap).alias("a"), F.count_if(bad & ~gap).alias("b"), F.count_if(~bad & gap).alias("c"), F.count_if(~bad & ~gap).alias("d")
    )


def pooled_d(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Cohen's d with the pooled standard deviation; NULL below two samples or without spread."""
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled >= 1e-12), F.abs(m2 - m1) / pooled)


def audit(cells: DataFrame, column: str, value: str, fault: str, null_limit: float = 50.0, auc_floor: float = 0.10) -> DataFrame:
    """One row per column: nulls, distinct values, class moments, rank AUC, d and the decision."""
    bad, v = F.col(fault), F.col(value)
    normal, faulty = F.when(~bad, v), F.when(bad, v)
    moments = cells.groupBy(column).agg(
        (100.0 * F.count_if(v.isNull()) / F.count(F.lit(1))).alias("pct_null"),
        F.count(normal).alias("n_normal"), F.avg(normal).alias("mean_normal"), F.stddev_samp(normal).alias("std_normal"),
        F.count(faulty).alias("n_fault"), F.avg(faulty).alias("mean_fault"), F.stddev_samp(faulty).alias("std_fault"),
        F.var_samp(normal).alias("_v1"), F.var_samp(faulty).alias("_v2"),
    )
    distinct = cells.where(v.isNotNull()).select(column, value).distinct().groupBy(column).agg(F.count(F.lit(1)).alias("n_distinct"))
    auc = Q.ranked_sums(cells, [column], value, fault).select(column, "auc")
    out = moments.join(distinct, column, "left").join(auc, column, "left").na.fill(0, ["n_distinct"])
    out = out.withColumn("auc_dist", F.abs(F.col("auc") - 0.5) * 2).withColumn(
        "d_pooled", pooled_d(*[F.col(c) for c in ("n_normal", "mean_normal", "_v1", "n_fault", "mean_fault", "_v2")])
    ).drop("_v1", "_v2")
    decision = (
        F.when((F.col("pct_null") > null_limit) | (F.col("n_distinct") <= 1), "drop")
        .when(F.col("auc_dist").isNull() | (F.col("auc_dist") < auc_floor), "question").otherwise("keep")
    )
    return out.withColumn("decision", decision)


def separation(rows: DataFrame, keys: list[str], value: str, during: Column, before: Column, floor: float) -> DataFrame:
    """|difference of means| over the larger of the background deviation and a floor, where both
    windows hold three samples."""
    base, fault = F.when(before, F.col(value)), F.when(during, F.col(value))
    out = rows.groupBy(*keys).agg(
        F.count(base).alias("_nb"), F.count(fault).alias("_nf"), F.avg(base).alias("_mb"), F.avg(fault).alias("_mf"), F.stddev_pop(base).alias("_s")
    )
    value = F.abs(F.col("_mf") - F.col("_mb")) / F.greatest(F.col("_s"), F.lit(floor))
    return out.select(*keys, F.when((F.col("_nb") >= 3) & (F.col("_nf") >= 3), value).alias("separation"))


def failed(gates: dict[str, Column]) -> Column:
    """Names of the gates that are not true, in order, joined by commas."""
    names = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates.items()])
    return F.array_join(F.filter(names, lambda n: n.isNotNull()), ",")
