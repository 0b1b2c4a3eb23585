"""Pairing and matching of records: latest row per key, intent/result, as-of, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import scan as S


def last_per_key(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row per key in ``order``, from one partial aggregation."""
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *columns)).alias("_l")).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in (*order, *columns)])


def pair_intents(intents: DataFrame, results: DataFrame, cid: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each intent with the last result of its correlation id, if any."""
    return intents.join(last_per_key(results, [cid], order, columns), cid, "left")


def orphans(intents: DataFrame, results: DataFrame, cid: str) -> DataFrame:
    return intents.join(results, cid, "left_anti")


def expired_leases(leases: DataFrame, closes: DataFrame, keys: list[str], start: str, now: Column, max_open: float) -> DataFrame:
    """Open interventions past their lease: no matching close, and the clock beyond the limit."""
    return leases.join(closes, keys, "left_anti").where(now >= F.col(start) + F.lit(max_open))


def completeness(expected: DataFrame, actual: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Expected, actual, missing and extra per group, from one full outer join."""
    both = expected.select(*keys, *by, F.lit(1).alias("_e")).join(actual.select(*keys, *by, F.lit(1).alias("_a")), [*keys, *by], "full_outer")
    e, a = F.col("_e").isNotNull(), F.col("_a").isNotNull()
    return both.groupBy(*by).agg(
        F.count_if(e).alias("expected"), F.count_if(a).alias("actual"), F.count_if(e & ~a).alias("missing"), F.count_if(a & ~e).alias("extra")
    )


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, columns: list[str], width: float | None = None, forward: bool = False) -> DataFrame:
    """Each left row with the nearest right row at or before it (or at or after it) per key.
    Both sides are merged into one ordered sequence and the value is carried along it, so the
    work grows with the rows and not with row pairs. At equal times a backward match counts."""
    seen = right.select(*keys, F.col(at).alias("_at"), F.struct(F.col(at).alias("at"), *columns).alias("_r"), F.lit(0).alias("_side"))
    seen = seen.groupBy(*keys, "_at", "_side").agg(F.max("_r").alias("_r"))
    asks = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side")).distinct()
    rows = asks.unionByName(seen, allowMissingColumns=True)
    rows = rows.withColumn("_pos", -F.col("_at") if forward else F.col("_at"))
    chunk = S.range_chunk("_pos", width or S.even_width(rows, keys, "_at"))
    carried = S.scan(rows, keys, ["_pos", "_side"], chunk, _hit=S.last_known(F.col("_r")))
    found = carried.where("_side = 1").select(*keys, F.col("_at").alias(at), F.col("_hit"))
    return S.join_null_safe(left, found, [*keys, at])


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Path by path: same, differs, only_left or only_right."""
    both = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_in_a")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_in_b")), keys, "full_outer")
    same = F.col("_a").eqNullSafe(F.col("_b")) | F.coalesce(F.abs(F.col("_a") - F.col("_b")) < tolerance, F.lit(False))
    verdict = F.when(F.col("_in_b").isNull(), "only_left").when(F.col("_in_a").isNull(), "only_right").when(same, "same").otherwise("differs")
    return both.select(*keys, verdict.alias("verdict"))
