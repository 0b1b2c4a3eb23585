"""Top rows per key without sorting a whole key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_per_key(df: DataFrame, keys: list[str], value: str, ties: list[str], n: int, ascending: bool = False, name: str = "rank") -> DataFrame:
    """The ``n`` best rows per key with their rank. Rows are ranked inside salted parts first, so
    only n x salts rows of a key meet in the final ranking; the result is exact."""
    side = F.col(value).asc() if ascending else F.col(value).desc_nulls_last()
    order = [side, *ties]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*ties), F.lit(SALTS)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    short = salted.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n)
    final = short.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return final.where(F.col(name) <= n).drop("_salt", "_r")
