"""Isolation forest: one small sample and one tree per group, rows scored where they lie.

Sampling, grouping and scoring are Spark's; Python grows one tree from at most ``sample`` rows
and walks batches of rows through the node table, whose size is bounded by trees x 2 x sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.operators.ranking import top_per_key

NODES = "tree bigint, node bigint, feature bigint, split double, left bigint, right bigint, size bigint, depth bigint"


def mean_path(n: float) -> float:
    """Average depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def tree_samples(rows: DataFrame, key: str, n_rows: int, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, row) pairs: each row is handed to a few trees by hash, and each tree keeps the
    ``sample`` rows with the smallest hash. A large input is thinned by hash before it is spread."""
    target = trees * sample * 2
    copies = max(1, min(trees, math.ceil(target / max(n_rows, 1))))
    share = min(1.0, target / max(n_rows, 1))
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    spread = rows.where(unit < share).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    first = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(trees))
    placed = spread.withColumn("tree", F.pmod(first + F.col("_c"), F.lit(trees))).withColumn("_h", F.xxhash64(F.lit(seed + 2), F.col(key), F.col("tree")))
    return top_per_key(placed, ["tree"], "_h", [key], sample, ascending=True).drop("_c", "_h", "rank")


def fit(rows: DataFrame, key: str, columns: list[str], n_rows: int, trees: int = 300, sample: int = 256, seed: int = 0) -> DataFrame:
    """Node table of the forest."""
    depth_limit = max(1, math.ceil(math.log2(max(min(sample, n_rows), 2))))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        part = part.sort_values(key)
        values, rng = part[columns].to_numpy(float), np.random.default_rng((seed, tree))
        out, todo = [], [(np.arange(len(values)), 0, 0)]
        next_id = 1
        while todo:
            index, node, depth = todo.pop()
            low, high = values[index].min(axis=0), values[index].max(axis=0)
            free = np.flatnonzero(high > low)
            if depth >= depth_limit or len(index) <= 1 or not len(free):
                out.append((tree, node, -1, 0.0, -1, -1, len(index), depth))
                continue
            feature = int(rng.choice(free))
            split = float(rng.uniform(low[feature], high[feature]))
            side = values[index, feature] <= split
            out.append((tree, node, feature, split, next_id, next_id + 1, len(index), depth))
            todo += [(index[side], next_id, depth + 1), (index[~side], next_id + 1, depth + 1)]
            next_id += 2
        return pd.DataFrame(out, columns=["tree", "node", "feature", "split", "left", "right", "size", "depth"])

    samples = tree_samples(rows.select(key, *columns), key, n_rows, trees, sample, seed)
    return samples.groupBy("tree").applyInPandas(grow, NODES)


def score(rows: DataFrame, nodes: DataFrame, columns: list[str], sample: int) -> DataFrame:
    """Add ``score``: minus the anomaly score, so lower is stranger. The node table is bounded by
    the forest's parameters and goes to the workers as arrays."""
    table = nodes.toPandas()
    trees = []
    for _, part in table.groupby("tree", sort=True):
        part = part.sort_values("node")
        leaf = np.array([d + mean_path(s) for d, s in zip(part["depth"], part["size"])])
        trees.append((part["feature"].to_numpy(), part["split"].to_numpy(), part["left"].to_numpy(), part["right"].to_numpy(), leaf))
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    norm = max(mean_path(sample), 1e-9)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch[columns].to_numpy(float)
            total = np.zeros(len(values))
            for feature, split, left, right, leaf in shared.value:
                at = np.zeros(len(values), dtype=int)
                while True:
                    inner = feature[at] >= 0
                    if not inner.any():
                        break
                    rows_ = np.flatnonzero(inner)
                    here = at[rows_]
                    at[rows_] = np.where(values[rows_, feature[here]] <= split[here], left[here], right[here])
                total += leaf[at]
            batch["score"] = -np.power(2.0, -total / max(len(shared.value), 1) / norm)
            yield batch

    return rows.mapInPandas(walk, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def split_usage(nodes: DataFrame, n: int = 10) -> DataFrame:
    """Columns by number of splits, with their share."""
    used = nodes.where("feature >= 0").groupBy("feature").agg(F.count(F.lit(1)).alias("n_splits"))
    whole = F.broadcast(used.agg(F.sum("n_splits").alias("_all")))
    return used.join(whole).select("feature", "n_splits", (F.col("n_splits") / F.col("_all")).alias("share")).orderBy(F.desc("n_splits"), "feature").limit(n)
