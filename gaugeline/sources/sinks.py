"""Exports, sealed result documents, append logs and latest-state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def export_csv(df: DataFrame, path: str) -> None:
    """Header row, and an empty cell for what was not measured."""
    df.write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def bounds_drift(df: DataFrame, bounds: DataFrame, column: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """Columns whose extremes do not reproduce the stored bounds."""
    seen = df.groupBy(column).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    both = bounds.join(seen, column, "left")
    same = (F.abs(F.col("_lo") - F.col("lo")) <= tolerance) & (F.abs(F.col("_hi") - F.col("hi")) <= tolerance)
    return both.select(column, "lo", "hi", F.coalesce(same, F.lit(False)).alias("reproduced"))


def canonical(column: Column, kind: T.DataType) -> Column:
    """The value with struct fields and map keys in name order, at every level."""
    if isinstance(kind, T.StructType):
        fields = [canonical(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: canonical(x, kind.elementType))
    return column


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """JSON text of the columns with all names in order; NULL is written, as it is not the same as absent."""
    fields = [canonical(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def sealed(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the canonical JSON text of the columns."""
    return F.sha2(canonical_json(df, columns), 256)


def write_once(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append_log(df: DataFrame, path: str, by: str) -> None:
    """Append-only log, one folder per day instead of rotation."""
    df.write.mode("append").partitionBy(by).parquet(path)


def latest_state(updates: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Last value per key; ties follow ``order``."""
    best = F.max(F.struct(*order, *values)).alias("_b")
    return updates.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in (*order, *values)])


def replace_run(train: DataFrame, pool: DataFrame, old: Column, new: Column, columns: list[str]) -> DataFrame:
    """Training set with one run taken out and another one put in."""
    return train.where(~old).select(*columns).unionByName(pool.where(new).select(*columns))
