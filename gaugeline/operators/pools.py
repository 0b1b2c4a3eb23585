"""Instance pools: counts by life cycle, scaling segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pool_counts(instances: DataFrame, keys: list[str], extra: list[Column] | None = None) -> DataFrame:
    state, serving = F.col("lifecycle"), F.col("lifecycle") == "InService"
    return instances.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(state.startswith("Pending")).alias("pending"), F.count_if(serving).alias("in_service"),
        F.count_if(serving & (F.col("health") == "healthy")).alias("healthy"), F.count_if(state.startswith("Terminating")).alias("terminating"), *(extra or []),
    )


def first_time(samples: DataFrame, trials: DataFrame, keys: list[str], test: Column, after: str, name: str) -> DataFrame:
    """Add to each trial the first sample time at or after ``after`` on which the test holds;
    trials without ``after`` get none."""
    hits = samples.where(test).join(trials.select(*keys, F.col(after).alias("_after")), keys).where(F.col("t") >= F.col("_after"))
    return trials.join(hits.groupBy(*keys).agg(F.min("t").alias(name)), keys, "left")
