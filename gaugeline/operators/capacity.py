"""Wanted capacity from utilisation and link state, as latches over streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import scan as S


def wanted_level(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, rho: str, link_down: str, trusted: Column,
    high: float = 0.8, low: float = 0.3, n_up: int = 3, n_down: int = 3, k_down: int = 2, k_up: int = 3, top: int = 2,
) -> DataFrame:
    """Observations that are not trusted are skipped and leave all streaks as they are."""
    seen = df.where(trusted).withColumn("_k", chunk)
    run = S.streaks(seen, keys, order, "_k", {
        "_hi": F.col(rho) > high, "_lo": F.col(rho) < low, "_dn": F.col(link_down), "_up": ~F.col(link_down),
    }, settle=True)
    out = S.scan(
        run, keys, order, "_k",
        load=S.last_known(F.when(F.col("_hi") >= n_up, 1).when(F.col("_lo") >= n_down, 0)),
        failover=S.last_known(F.when(F.col("_dn") >= k_down, 1).when(F.col("_up") >= k_up, 0)),
    )
    out = out.withColumns({"load": F.coalesce("load", F.lit(0)), "failover": F.coalesce("failover", F.lit(0))})
    return out.withColumn("target", F.least(F.lit(top), F.col("load") + F.col("failover"))).drop("_hi", "_lo", "_dn", "_up", "_k")
