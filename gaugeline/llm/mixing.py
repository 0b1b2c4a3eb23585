"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks by a hash of its documents, which permutes them. A source's target
is a number of whole passes over its blocks plus the first blocks of one more pass; this exact quota
of blocks is split among the output shards by a binary tree: at each node the blocks that go left
are drawn without replacement from all sources at once. A node passes on where its blocks start, so
the shards hold disjoint ranges of each source's permuted blocks and no block is looked up twice.
Inside a shard the documents are ordered by a second hash.

Only counts travel through the tree: a node is one row with one entry per source. Documents are
shuffled once, to (source, block), whose size does not depend on the source's, or for the mix itself to
its shards: all documents of a block that one pass takes lie in one shard, which tells where it ends.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source of
its own, last in order; rows with a null or repeated doc_id are separate documents; a source
without words has target 0; an empty table gives an empty mix. Reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.rules import words_of
from gaugeline.operators.scan import scan, total
from gaugeline.session import cut_lineage

#: Fixed values of the contract: weights in source order, and the most passes over a source.
WEIGHTS = (5, 2, 1)
MOST = 3

NODE = "lo bigint, hi bigint, parts array<struct<source_id: bigint, start: bigint, n: bigint>>"
DEPTH = 8  # levels that one task goes down


def document_size(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def source_targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, n_docs, source_size, source_id, target.

    The shares by weight, cut off at ``most`` times the size with the excess shared again, are
    least(weight * level, most * size) for one level. Sources are full in the order of
    most * size / weight; the level is the first that leaves the next source below its limit."""
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(by_name) - 1
    out = per_source.withColumn("source_id", number.cast("bigint"))
    out = out.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_id") % len(weights) + 1).cast("int")))
    out = out.withColumn("_full", F.col("source_size") * most).withColumn("_ratio", F.col("_full") / F.col("_w"))
    by_ratio = everything.orderBy("_ratio", "source_id")
    before = F.coalesce(F.sum("_full").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("_level", (F.sum("source_size").over(everything) - before) / weight_left)
    out = out.withColumn("_at", F.row_number().over(by_ratio))
    fits = F.when(F.col("_level") <= F.col("_ratio"), F.struct("_at", "_level"))
    out = out.withColumn("_level", F.min(fits).over(everything)["_level"])
    target = F.least(F.col("_w") * F.col("_level"), F.col("_full").cast("double"))
    return out.select("source", "n_docs", "source_size", "source_id", target.alias("target"))


def split_nodes(seed: int):
    """Splits each node down to shards, :data:`DEPTH` levels at most."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo, hi, parts in batch.itertuples(index=False, name=None):
                ids = [int(p["source_id"]) for p in parts]
                todo = [(int(lo), int(hi), np.array([p["start"] for p in parts], np.int64), np.array([p["n"] for p in parts], np.int64), 0)]
                done = []
                while todo:
                    lo, hi, start, n, depth = todo.pop()
                    if hi - lo == 1 or depth == DEPTH:
                        done.append((lo, hi, [{"source_id": s, "start": int(a), "n": int(k)} for s, a, k in zip(ids, start, n, strict=True)]))
                        continue
                    middle = (lo + hi) // 2
                    left = draw(np.random.Generator(np.random.Philox(key=[seed, (lo << 32) ^ hi])), n, int(n.sum()) * (middle - lo) // (hi - lo))
                    todo += [(lo, middle, start, left, depth + 1), (middle, hi, start + left, n - left, depth + 1)]
                yield pd.DataFrame(done, columns=["lo", "hi", "parts"])

    return split


def draw(rng: np.random.Generator, counts: np.ndarray, k: int) -> np.ndarray:
    """How many of ``k`` blocks drawn without replacement come from each source."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, n in enumerate(counts.tolist()):
        rest -= n
        out[i] = rng.hypergeometric(n, rest, k) if n and rest else min(n, k)
        k -= int(out[i])
    return out


def shard_blocks(spark, quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(source_id, v, shard): the shard of each block v of a source's quota."""
    part = F.struct("source_id", F.lit(0).cast("bigint").alias("start"), F.col("quota").cast("bigint").alias("n"))
    nodes = quotas.groupBy().agg(F.sort_array(F.collect_list(part)).alias("parts")).select(F.lit(0).cast("bigint").alias("lo"), F.lit(n_shards).cast("bigint").alias("hi"), "parts")
    for _ in range(max(1, math.ceil(math.log2(max(n_shards, 2)) / DEPTH))):
        nodes = nodes.repartition("lo").mapInPandas(split_nodes(seed), NODE)
    leaf = nodes.select(F.col("lo").alias("shard"), F.explode("parts").alias("p")).where("p.n > 0")
    return leaf.select("p.source_id", "shard", F.explode(F.sequence(F.col("p.start"), F.col("p.start") + F.col("p.n") - 1)).alias("v"))


def block_draws(sized: DataFrame, sources: DataFrame, seed: int = 1, block_docs: int = 256, shard_words: int = 5_000_000) -> tuple[DataFrame, DataFrame]:
    """``sized`` (with source and size) with the figures of its source, ``_key`` and ``_block``; and of each
    block the words before it (``_offset``) and ``_draws``, the (pass, shard) that take it. ``sized`` is read twice."""
    spark = sized.sparkSession
    sources = cut_lineage(sources.withColumns({
        "n_blocks": F.ceil(F.col("n_docs") / block_docs),
        "passes": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
    }).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumnRenamed("source", "_source"))
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("bigint")
    placed = sized.withColumn("_key", key).join(sources, F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.withColumn("_block", F.pmod(F.col("_key"), F.col("n_blocks")))

    blocks = cut_lineage(placed.groupBy("source_id", "_block").agg(F.sum("size").alias("_words"), F.first("n_blocks").alias("n_blocks"), F.first("passes").alias("passes"), F.first("rest").alias("rest")))
    offsets = scan(blocks, ["source_id"], ["_block"], F.floor(F.col("_block") / 4096), True, _offset=total(F.col("_words"), before=True))
    offsets = cut_lineage(offsets)
    # the last pass takes the blocks that begin before its words are used up; blocks without documents exist too
    last = F.max(F.when(F.col("_offset") < F.col("rest"), F.col("_block") + 1))
    quotas = offsets.groupBy("source_id").agg((F.max(F.col("passes") * F.col("n_blocks")) + F.coalesce(last, F.lit(0))).alias("quota"))
    words = sources.agg(F.sum("target")).first()[0] or 0.0
    drawn = shard_blocks(spark, quotas, max(1, math.ceil(words / shard_words)), seed)
    drawn = drawn.join(sources.select("source_id", "n_blocks"), "source_id").groupBy("source_id", (F.col("v") % F.col("n_blocks")).alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct(F.floor(F.col("v") / F.col("n_blocks")).alias("pass"), F.col("shard")))).alias("_draws"))
    return placed, offsets.select("source_id", "_block", "_offset").join(drawn, ["source_id", "_block"], "left")


def early(before: Column) -> Column:
    """Whether the last pass takes a document with ``before`` words of its block before it."""
    return 2 * (F.col("_offset") + before) + F.col("size") <= 2 * F.col("rest")


def draw_mix(sized: DataFrame, sources: DataFrame, seed: int = 1, **settings) -> DataFrame:
    """``sized`` (with source and size) with source_size, target and ``drawn``: an array of
    (shard, pass), one for each time the mix takes the document."""
    placed, drawn = block_draws(sized, sources, seed, **settings)
    inside = Window.partitionBy("source_id", "_block").orderBy("_key", "doc_id", "size")
    ahead = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = placed.withColumn("_ahead", ahead).join(drawn, ["source_id", "_block"], "left")
    taken = F.filter("_draws", lambda d: (F.col("size") > 0) & ((d["pass"] < F.col("passes")) | ((d["pass"] == F.col("passes")) & early(F.col("_ahead")))))
    taken = F.coalesce(taken, F.array().cast("array<struct<pass: bigint, shard: bigint>>"))
    return out.select(*sized.columns, "source_size", "target", taken.alias("drawn"), "_key")


def with_targets(sized: DataFrame) -> DataFrame:
    return source_targets(sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")))


def mix(docs: DataFrame, seed: int = 1, **settings) -> DataFrame:
    """The mixed documents: rows of ``docs``, repeated as often as taken, with ``shard`` and the
    ``pass`` that took them, one shard after another in its own random order. Columns of these
    two names are replaced."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "pass")]
    sized = docs.select(F.struct(*kept).alias("_row"), "doc_id", "source", document_size(F.col("text")).alias("size"))
    placed, drawn = block_draws(sized, with_targets(sized.select("source", "size")), seed, **settings)
    # written first, so that its size is known: a short table of blocks is sent to the texts, and not they to it
    rows = placed.where("size > 0").join(cut_lineage(drawn.where("_draws is not null")), ["source_id", "_block"])
    rows = rows.select("_row", "_key", "doc_id", "size", "source_id", "_block", "_offset", "passes", "rest", F.explode("_draws").alias("_d"))
    rows = rows.where("_d.pass <= passes").withColumns({"_shard": F.col("_d.shard"), "_pass": F.col("_d.pass")}).drop("_d").repartition("_shard")
    inside = Window.partitionBy("_shard", "source_id", "_block", "_pass").orderBy("_key", "doc_id", "size")
    ahead = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_ahead", ahead).where((F.col("_pass") < F.col("passes")) | early(F.col("_ahead")))
    rows = rows.withColumn("_order", F.xxhash64(F.lit(seed), "_key", "_shard", "_pass"))
    return rows.sortWithinPartitions("_shard", "_order").select("_row.*", F.col("_shard").alias("shard"), F.col("_pass").alias("pass"))
