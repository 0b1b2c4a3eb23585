"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments. With segment means m and deviations s, the squared distance of two
vectors is at least the sum of L ((m - m')^2 + (s - s')^2) over segments of length L; as a bound on
the inner product that is at most the sum of L (m m' + s s'). The bounds get tighter from coarse to
fine segments. Per query the candidates with the best coarse bounds are scored exactly, their k-th
score prunes level by level, and exact products are computed for the survivors only.

Queries and candidates are hashed into blocks; every pair of blocks is one group with a fixed number
of rows, so no task holds more than two blocks and nothing is broadcast. The best k of each pair of
blocks are merged by a rank, which Spark limits before its shuffle.

Defined results: a vector that is null, or holds null, NaN or infinite components, takes no part, nor
does a row without id; vectors of different lengths are not compared; rows that share the query's
id are its own; a repeated query row counts once; fewer candidates than k give fewer rows.
Scores are exact; beyond 64 bits they saturate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PACKED = "vec_id bigint, dims int, data binary"
SCALE = 256.0
LEVELS = (1, 4, 16)
EXACT = 2.0**53


def quantise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """floor(256 x) of every component as doubles; vectors that take no part are left out."""
    for batch in batches:
        ids, dims, data = [], [], []
        for vec_id, vector in zip(batch["vec_id"], batch["embedding"], strict=True):
            if vec_id is None or vector is None or vec_id != vec_id:
                continue
            x = np.floor(np.asarray(vector, dtype=np.float64) * SCALE) + 0.0  # null components arrive as NaN
            if np.isfinite(x).all():
                ids.append(int(vec_id)), dims.append(len(x)), data.append(x.tobytes())
        yield pd.DataFrame({"vec_id": np.array(ids, np.int64), "dims": np.array(dims, np.int32), "data": data})


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose products are the bounds: root L times mean and deviation of each segment."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    size = np.diff(edges).astype(float)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / size
    return np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0.0))]) * np.sqrt(np.tile(size, 2))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``x`` with ``q``, as 64-bit integers."""
    if x.shape[1] * np.abs(x).max(initial=0.0) * np.abs(q).max(initial=0.0) < EXACT:
        return np.rint(x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    low, high = -(2**63), 2**63 - 1
    return np.array([min(high, max(low, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in x], np.int64)


def block_pair(k: int):
    def score(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            dims = int(queries["dims"].iloc[0])
            order = np.argsort(candidates["vec_id"].to_numpy(), kind="stable")
            ids = candidates["vec_id"].to_numpy()[order]
            x = np.frombuffer(b"".join(candidates["data"]), np.float64).reshape(len(candidates), dims)[order]
            q = np.frombuffer(b"".join(queries["data"]), np.float64).reshape(len(queries), dims)
            levels = [s for s in LEVELS if s < dims]
            xs, qs = [features(x, s) for s in levels], [features(q, s) for s in levels]
            slack = 1e-6 + 1e-9 * math.sqrt(float((x * x).sum(1).max()) * float((q * q).sum(1).max())) if dims else 1.0
            for i, (query_id, key) in enumerate(zip(queries["vec_id"], queries["key"], strict=True)):
                alive = np.flatnonzero(ids != query_id)
                if levels and len(alive) > k:
                    bound = xs[0] @ qs[0][i]
                    first = alive[np.argpartition(-bound[alive], k - 1)[:k]]
                    least = float(products(x[first], q[i]).min())
                    alive = alive[bound[alive] >= least - slack]
                    for xf, qf in zip(xs[1:], qs[1:], strict=True):
                        alive = alive[xf[alive] @ qf[i] >= least - slack]
                scores = products(x[alive], q[i])
                best = np.argsort(-scores, kind="stable")[:k]  # ids ascend, so ties go to the smaller
                out += [(int(query_id), int(key), int(ids[alive[b]]), int(scores[b])) for b in best]
        return pd.DataFrame(out, columns=["query_id", "key", "vec_id", "score"]).astype("int64")

    return score


def search(vectors: DataFrame, is_query: Column, k: int = 5, query_block: int = 1024, candidate_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best candidates of each row for which ``is_query``."""
    packed = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInPandas(quantise, PACKED)
    sides = vectors.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    n_candidates, n_queries = max(1, math.ceil(sides[0] / candidate_block)), max(1, math.ceil(sides[1] / query_block))
    key = F.xxhash64("vec_id", "data")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = packed.where(is_query).dropDuplicates(["vec_id", "data"]).withColumn("key", key)
    queries = queries.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(n_queries)).cast("int").alias("qb"), numbers(n_candidates).alias("cb"))
    candidates = packed.select("*", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_candidates)).cast("int").alias("cb"), numbers(n_queries).alias("qb"))
    found = queries.groupBy("qb", "cb", "dims").cogroup(candidates.groupBy("qb", "cb", "dims")).applyInPandas(block_pair(k), "query_id bigint, key bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
