"""Quality score by a regularised quadratic discriminant on statistics of whole texts.

``features`` turns each text into a fixed number of transformed statistics (logarithms of counts and
of ratios). Count, sum and products of the labelled rows are added up per class on Spark; only these
few numbers come to the driver, where each class covariance is shrunk towards the pooled one and
towards its diagonal. A score is the logistic of the prior ratio plus the difference of the log
densities, whose Mahalanobis parts use the Cholesky factor of each class, factored once.

The densities are not exactly normal, so the difference is divided by a temperature fitted on the
training rows; it changes no order of scores.

Defined results: a null, empty or blank text gets the statistics of the empty text and a score like
any other; without labels every score is 0.5, with one class only it is that class's smoothed share;
a document with several labels counts as their majority, ties as 1; a null doc_id is held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm.blocks import Block, blocks, range_hashes, word_ranges
from gaugeline.session import cut_lineage

STATISTICS = (
    "words", "word_bytes", "lines", "words_per_line", "symbols", "bars", "shouts", "capitals", "digits", "stops", "other_marks",
    "wide", "distinct_words", "repeat_windows", "repeat_lines", "longest_word",
)
SMALL = 1e-3  # ratios below this count as equal


def count_of(members: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members.encode())] = True
    return out


MARKS = {
    "symbols": count_of("#*$%&<>"), "bars": count_of("|"), "shouts": count_of("!"), "capitals": count_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digits": count_of("0123456789"), "stops": count_of(".,;:?"), "other_marks": count_of("@()[]{}=+/\\_~^`\"'-"),
}
LINE = count_of("\n")


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds]).astype(float)


def distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each owner."""
    if not len(values):
        return np.zeros(n)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n).astype(float)


def block_statistics(block: Block) -> np.ndarray:
    """One row of transformed statistics per text."""
    data, bounds, n = block.data, block.bounds, len(block.bounds) - 1
    starts, ends, at = word_ranges(data, bounds)
    owner = np.repeat(np.arange(n), np.diff(at))
    words = np.diff(at).astype(float)
    some = np.maximum(words, 1.0)
    size = np.maximum(per_text(np.ones(len(data), bool), bounds), 1.0)
    hashes = range_hashes(data, starts, ends)
    inner = owner[2:] == owner[:-2] if len(owner) > 2 else np.zeros(0, bool)
    windows = (hashes[:-2] + hashes[1:-1] * np.uint64(3) + hashes[2:] * np.uint64(0x9E3779B97F4A7C15))[inner] if len(inner) else np.zeros(0, np.uint64)
    in_windows = owner[:-2][inner] if len(inner) else np.zeros(0, np.int64)
    # a line is a run of words between newlines; its hash is the sum of those of its words at their places
    line = np.concatenate([[0], np.cumsum(LINE[data])])[starts] if len(starts) else np.zeros(0, np.int64)
    new_line = np.ones(len(starts), bool)
    new_line[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new_line)
    place = np.arange(len(starts)) - np.repeat(first, np.diff(first, append=len(starts)))
    lines = np.add.reduceat(hashes * (2 * place + 1).astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
    n_lines = np.bincount(owner[first], minlength=n).astype(float)
    n_windows = np.bincount(in_windows, minlength=n).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, (ends - starts).astype(float))
    out = {
        "words": np.log1p(words), "word_bytes": np.log1p(per_text(np.ones(len(data), bool), bounds) / some), "lines": np.log1p(n_lines),
        "words_per_line": np.log1p(words / np.maximum(n_lines, 1.0)), "wide": np.log(SMALL + per_text(data >= 0x80, bounds) / size),
        "distinct_words": np.log(SMALL + distinct(hashes, owner, n) / some), "longest_word": np.log1p(longest),
        "repeat_windows": np.log(SMALL + (n_windows - distinct(windows, in_windows, n)) / np.maximum(n_windows, 1.0)),
        "repeat_lines": np.log(SMALL + (n_lines - distinct(lines, owner[first], n)) / np.maximum(n_lines, 1.0)),
    }
    out |= {name: np.log(SMALL + per_text(flags[data], bounds) / size) for name, flags in MARKS.items()}
    return np.column_stack([out[name] for name in STATISTICS])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features(docs: DataFrame) -> DataFrame:
    """``docs`` without its text and with ``x``, the statistics of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n not in ("text", "x")]
            for block in blocks(batch.column("text")):
                x = block_statistics(block)
                part = batch.slice(block.first, block.last - block.first)
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), column], names=[*names, "x"])

    kept = [f for f in docs.schema.fields if f.name not in ("text", "x")]
    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("x", T.ArrayType(T.DoubleType()))]))


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of both classes."""

    mean: np.ndarray
    factor: np.ndarray
    offset: float
    temperature: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """log p(1, x) - log p(0, x)."""
        if not self.mean.size:
            return np.full(len(x), self.offset)
        distance = [(((x - m) @ f.T) ** 2).sum(1) for m, f in zip(self.mean, self.factor, strict=True)]
        return (self.offset + (distance[0] - distance[1]) / 2) / self.temperature

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -500, 500)))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, mean and covariance (divided by the count) of ``x`` for each class of ``label``."""
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.get("x", F.lit(i)) for i in range(d)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    out = {}
    for row in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # two rows
        n, mean = float(row["n"]), np.array([row[f"s{i}"] for i in range(d)]) / row["n"]
        square = np.zeros((d, d))
        for i, j in pairs:
            square[i, j] = square[j, i] = row[f"p{i}_{j}"] / n
        out[int(row["label"])] = (n, mean, square - np.outer(mean, mean))
    return out


def fit(labelled: DataFrame, pooled_share: float = 0.1, diagonal_share: float = 0.05) -> Discriminant:
    """The discriminant of ``labelled`` (label 0 or 1, x). ``labelled`` is read twice, so store it first."""
    found = moments(labelled)
    n = {c: found[c][0] if c in found else 0.0 for c in (0, 1)}
    if not (n[0] and n[1]):
        share = 0.5 if not (n[0] or n[1]) else (n[1] + 1) / (n[0] + n[1] + 2)
        return Discriminant(np.zeros(0), np.zeros(0), float(np.log(share / (1 - share))))
    pooled = sum(found[c][2] * n[c] for c in (0, 1)) / (n[0] + n[1])
    factors, log_det = [], []
    for c in (0, 1):
        cov = (1 - pooled_share) * found[c][2] + pooled_share * pooled
        cov = (1 - diagonal_share) * cov + diagonal_share * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(cov))
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        log_det.append(2 * np.log(np.diag(low)).sum())
    made = Discriminant(np.stack([found[c][1] for c in (0, 1)]), np.stack(factors), float(np.log(n[1] / n[0]) + (log_det[0] - log_det[1]) / 2))
    made.temperature = temperature(labelled, made)
    return made


def temperature(labelled: DataFrame, made: Discriminant, grid: tuple[float, ...] = (1, 1.5, 2, 3, 4, 6, 8, 12, 16)) -> float:
    """The divisor with the least log loss over the training rows."""
    signed = scored(labelled, made, "margin").select(F.when(F.col("label") == 1, -F.col("margin")).otherwise(F.col("margin")).alias("m"))
    loss = [F.avg(F.greatest(F.col("m") / t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(F.col("m") / t)))).alias(str(t)) for t in grid]
    row = signed.agg(*loss).first()
    return float(min(grid, key=lambda t: row[str(t)]))


def scored(statistics: DataFrame, made: Discriminant, name: str = "score") -> DataFrame:
    """``statistics`` with ``name`` in place of ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))
            value = made.score(x) if name == "score" else made.margin(x)
            names = [n for n in batch.schema.names if n not in ("x", name)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(value)], names=[*names, name])

    kept = [f for f in statistics.schema.fields if f.name not in ("x", name)]
    return statistics.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def train(statistics: DataFrame, labels: DataFrame, **settings) -> Discriminant:
    """Fit on the rows of ``statistics`` that have a label and are not held out."""
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    joined = statistics.where(~held_out()).join(one, F.col("doc_id") == F.col("_id")).select("label", "x")
    return fit(cut_lineage(joined), **settings)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    statistics = cut_lineage(features(docs.select("doc_id", "text")))
    out = scored(statistics, train(statistics, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    made = train(cut_lineage(features(docs.select("doc_id", "text"))), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                kept = made.score(block_statistics(block)) >= threshold
                yield batch.slice(block.first, block.last - block.first).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
