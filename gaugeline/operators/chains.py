"""Hash chains: every row stores the hash of the line before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import scan as S

GENESIS = "genesis"


def chain_faults(log: DataFrame, keys: list[str], seq: str, line: str, prev_hash: str) -> DataFrame:
    """Rows whose stored hash is not the hash of the line before, or whose number does not follow."""
    told = S.scan(log, keys, [seq], S.tick_chunk(seq), _p=S.previous(F.struct(F.col(line).alias("line"), F.col(seq).alias("seq"))))
    expected = F.coalesce(F.sha2(F.col("_p.line"), 256), F.lit(GENESIS))
    jump = F.col("_p").isNotNull() & (F.col(seq) != F.col("_p.seq") + 1)
    return told.withColumn("broken", ~F.col(prev_hash).eqNullSafe(expected) | jump).drop("_p")


def verify_chain(log: DataFrame, keys: list[str], seq: str, line: str, prev_hash: str) -> DataFrame:
    """Rows, breaks and the first break per chain."""
    checked = chain_faults(log, keys, seq, line, prev_hash)
    return checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("broken").alias("n_breaks"),
        F.min(F.when(F.col("broken"), F.col(seq))).alias("first_break"),
    )
