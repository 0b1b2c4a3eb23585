"""Joins and graph steps shared by the duplicate operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.session import cut_lineage

#: Ids that are broadcast at most: about 16 MB; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def join_ids(df: DataFrame, small: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """``df`` joined to a stored table of ids (and few narrow columns), without moving ``df`` while
    the table is counted to be small; beyond that by an ordinary join."""
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_IDS else small, on, how)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches in which the rows of a key follow each other: all groups that
    end within the batch at hand, so a group that crosses batches comes once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key)
        last, first = column[batch.num_rows - 1], column[0]
        if last == first and (not held or held[-1].column(key)[0] == last):
            held.append(batch)
            continue
        low, high = 0, batch.num_rows - 1  # the first row of the last group
        while low < high:
            middle = (low + high) // 2
            if column[middle] == last:
                high = middle
            else:
                low = middle + 1
        while low and column[low - 1] == last:
            low -= 1
        yield pa.Table.from_batches([*held, batch.slice(0, low)])
        held = [batch.slice(low)]
    if held:
        yield pa.Table.from_batches(held)


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, root) for the edges of one task, by smallest labels and pointer jumps."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(side) for side in zip(*parts, strict=True))
    names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = codes[: len(a)], codes[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)  # the roots learn, so whole trees move at once
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["v", "root"])


def components(edges: DataFrame, per_task: int = 500_000) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b: bigint): equal roots mean connected.

    Each task first reduces at most about ``per_task`` edges to a forest; if one task was enough, that is
    the result. Otherwise the trees are contracted over all tasks: in each round every vertex joins
    its neighbour, or itself, with the smallest hash of the round, and edges are carried over to the
    joined vertices, until none is left. The vertices shrink by a constant factor per round whatever
    the shape of a component."""
    edges = cut_lineage(edges.where("a <> b").select("a", "b"))
    tasks = math.ceil(edges.count() / per_task)
    trees = cut_lineage(edges.coalesce(max(1, tasks)).mapInArrow(forest, "v bigint, root bigint"))
    if tasks <= 1:
        return trees
    edges = cut_lineage(trees.where("v <> root").select(F.least("v", "root").alias("a"), F.greatest("v", "root").alias("b")).distinct())
    found = cut_lineage(trees.select("v").distinct().withColumn("root", F.col("v")))
    rounds = 0
    while not edges.isEmpty():
        rounds += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(rounds), c).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), order("b").alias("to")), F.struct(F.col("b").alias("v"), order("a").alias("to")))).alias("x")).select("x.*")
        nearest = both.groupBy("v").agg(F.min("to").alias("to"))
        parent = cut_lineage(nearest.select("v", F.least(F.col("to"), order("v"))["v"].alias("p")))
        moved = edges.join(parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(parent.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        found = cut_lineage(found.join(parent.withColumnRenamed("v", "root"), "root", "left").select("v", F.coalesce("p", "root").alias("root")))
        edges = cut_lineage(moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return found
