"""Monotone reads, re-delivery, leases, caches and conflation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import scan as S


def monotone(df: DataFrame, keys: list[str], order: list[str], chunk: Column, boot: str, seq: str, at: str) -> DataFrame:
    """Which messages may be shown. The first message of a boot id is always taken and retires
    the boot before it, so the current boot is the one that appeared last; inside it ``seq`` must
    rise. ``confirmed_at`` is the time of the last taken message after the very first one."""
    by_boot = S.scan(df, [*keys, boot], order, chunk, True, _seen=S.count(before=True), _top=S.highest(F.col(seq), before=True))
    fresh = F.when(F.col("_seen") == 0, F.col(boot))
    cur = S.scan(by_boot, keys, order, chunk, True, _boot=S.last_known(fresh), _nth=S.count(before=True))
    taken = (F.col("_seen") == 0) | ((F.col(boot) == F.col("_boot")) & (F.col(seq) > F.col("_top")))
    cur = cur.withColumn("accepted", taken).withColumn("_confirm", F.when(F.col("accepted") & (F.col("_nth") > 0), F.col(at)))
    out = S.scan(cur, keys, order, chunk, confirmed_at=S.last_known(F.col("_confirm")))
    return out.drop("_seen", "_top", "_boot", "_nth", "_confirm")


def stale(now: Column, confirmed_at: Column, ttl: float) -> Column:
    return F.coalesce(now - confirmed_at > F.lit(ttl), F.lit(True))


def first_results(df: DataFrame, keys: list[str], cid: str, order: list[str]) -> DataFrame:
    """Keep the first message per correlation id; messages without id are all kept."""
    known = df.where(F.col(cid).isNotNull())
    rest = [c for c in df.columns if c not in (*keys, cid, *order)]
    first = known.groupBy(*keys, cid).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    kept = first.select(*keys, cid, *[F.col(f"_f.{c}").alias(c) for c in (*order, *rest)])
    return kept.select(*df.columns).unionByName(df.where(F.col(cid).isNull()))


def lease_expiries(df: DataFrame, keys: list[str], order: list[str], chunk: Column, at: str, lease: float) -> DataFrame:
    """One row per expiry: a renewal after the deadline, or none at all, lets the lease run out."""
    out = S.scan(df, keys, order, chunk, _next=S.following(F.col(at)))
    deadline = F.col(at) + F.lit(lease)
    return out.where(F.col("_next").isNull() | (F.col("_next") > deadline)).withColumn("expired_at", deadline).drop("_next")


def forward_fill(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: str) -> DataFrame:
    """Last known value with the flag that it is carried over."""
    out = S.scan(df, keys, order, chunk, filled=S.last_known(F.col(value)))
    return out.withColumn("stale", F.col(value).isNull() & F.col("filled").isNotNull())


def conflate(df: DataFrame, keys: list[str], seq: str, doc: str) -> DataFrame:
    """Latest document per key and how many it replaced."""
    return df.groupBy(*keys).agg(F.max_by(doc, seq).alias(doc), F.max(seq).alias(seq), (F.count(F.lit(1)) - 1).alias("overwritten"))
