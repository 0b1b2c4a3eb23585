"""Ranked lexical search with bag deduplication.

1. A pass over the documents counts the terms of each whole text and restricts it to the vocabulary of
   the items: its bag is the sorted list of (term, occurrences). Totals and document frequencies are
   partial sums over all documents.
2. Documents with the same bag and the same length class m have the same score for every item. They are
   grouped by a hash and by the bag itself, so a class is verified by equality, and a class keeps its
   ``k`` smallest doc_ids: more of its members cannot be among the best ``k`` of any item.
3. Classes are scored once, in blocks of rows against all items, as products of two matrices; each task
   keeps the best ``k`` documents of each item, and a class hands out its members by ascending doc_id.
   The lists of the tasks are merged in two steps.

Items are the stated query set. They are taken in blocks of at most about ``block_terms`` terms, so what
a task holds of them has a fixed bound; more items mean more passes, not larger tables.

Defined results: a null, empty or termless text is no document (it counts nowhere); a row without
doc_id counts in all statistics and is never returned; rows that share a doc_id are separate documents;
item rows that share an item_id are one item with the terms of its distinct texts; an item without id
or terms has no rows; without documents there are none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.blocks import LOWER, Block, blocks, ragged, range_hashes
from gaugeline.session import cut_lineage

#: Fixed values of the contract: bytes of terms (in UTF-8 every byte of a character beyond ASCII is one).
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SHIFT = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

EXACT = 2**53
SLICES = 64  # of the first merge


def term_ranges(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every term, and the text it is in."""
    inside = TERM[block.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[block.bounds] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
    return starts, ends, np.searchsorted(block.bounds[1:], starts, side="right")


@dataclass
class Vocabulary:
    """Terms by ascending hash, with their bytes for the proof that a hit is one."""

    hashes: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(terms: list[str]) -> tuple[Vocabulary, list[str]]:
        raw = [t.encode() for t in terms]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        starts = ends - [len(r) for r in raw]
        hashes = range_hashes(data, starts, ends)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two terms have the same 64-bit hash")
        order = np.argsort(hashes)
        return Vocabulary(hashes[order], data, starts[order], ends[order]), [terms[i] for i in order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each term in the vocabulary, or -1."""
        if not len(self.hashes):
            return np.full(len(starts), -1)
        h = range_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        at[(self.hashes[at] != h) | (self.ends[at] - self.starts[at] != ends - starts)] = -1
        hit = np.flatnonzero(at >= 0)
        if len(hit):
            size = (ends - starts)[hit]
            other = data[ragged(starts[hit], size)] != self.data[ragged(self.starts[at[hit]], size)]
            at[hit[np.add.reduceat(other, np.cumsum(size) - size) > 0]] = -1
        return at


def bags(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, counts) of every text with terms; ``terms`` are those of the vocabulary, ascending."""
    size = max(1, len(vocabulary.hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                starts, ends, owner = term_ranges(block)
                n = np.bincount(owner, minlength=block.last - block.first)
                term = vocabulary.find(LOWER[block.data], starts, ends)
                known = term >= 0
                key, count = np.unique(owner[known] * size + term[known], return_counts=True)
                some = np.flatnonzero(n)
                edges = np.append(np.searchsorted(key, some * size), len(key)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(v.astype(np.int32))) for v in (key % size, count)]
                ids = batch.column("doc_id").slice(block.first, block.last - block.first).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n[some].astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


def best_rows(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the ``k`` best of their item: highest score, then smallest doc_id."""
    order = np.lexsort((doc, -score, item))
    sorted_item = item[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_item, sorted_item)
    return order[place < k]


def scored(classes: DataFrame, weights: np.ndarray, items: np.ndarray, names: np.ndarray, k: int) -> DataFrame:
    """(item_id, score, doc_id): per task the best ``k`` documents of each item. ``items`` counts each term
    (row) in each item (column)."""
    exact_in_doubles = bool(len(weights)) and int((weights[:, None] * items).sum(axis=0, dtype=np.int64).max(initial=0)) * 10**6 < EXACT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        least = np.ones(items.shape[1], np.int64)  # a score below it is no longer among the best
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column("terms")
                sizes = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(part.num_rows), sizes)
                term, tf = lists.flatten().to_numpy(), part.column("counts").flatten().to_numpy().astype(np.int64)
                value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * part.column("m").to_numpy()[row]))
                used, column = np.unique(term, return_inverse=True)
                kind = np.float64 if exact_in_doubles else np.int64
                matrix = np.zeros((part.num_rows, len(used)), kind)
                matrix[row, column] = value
                score = (matrix @ items[used].astype(kind)).astype(np.int64)
                if len(score) >= k:
                    least = np.maximum(least, np.partition(score, len(score) - k, axis=0)[len(score) - k])
                rows, cols = np.nonzero(score >= least)
                ids = part.column("ids")
                heads, flat = ids.offsets.to_numpy(), ids.flatten().to_numpy()
                members = np.diff(heads)[rows]
                doc = flat[ragged(heads[rows] - heads[0], members)]
                new = [np.repeat(cols, members), np.repeat(score[rows, cols], members), doc]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)]
                if len(held[0]) > 4 * k * items.shape[1] + 10_000:
                    best = best_rows(*held, k)
                    held = [x[best] for x in held]
                    full = np.bincount(held[0], minlength=items.shape[1]) >= k
                    low = np.full(items.shape[1], np.iinfo(np.int64).max)
                    np.minimum.at(low, held[0], held[1])
                    least = np.where(full, np.maximum(least, low), least)
        best = best_rows(*held, k)
        item, score, doc = (x[best] for x in held)
        yield pa.RecordBatch.from_arrays([pa.array(names[item]), pa.array(score), pa.array(doc)], names=["item_id", "score", "doc_id"])

    return classes.mapInArrow(run, "item_id bigint, score bigint, doc_id bigint")


def search_block(docs: DataFrame, texts: dict[int, list[str]], k: int) -> DataFrame | None:
    """(item_id, rank, doc_id, score) for one block of items."""
    counts = {i: Counter(t for text in set(own) for t in TERMS.findall(text.translate(SHIFT))) for i, own in texts.items()}
    vocabulary, terms = Vocabulary.of(sorted({t for c in counts.values() for t in c}))
    names = np.array(sorted(i for i, c in counts.items() if c), np.int64)
    if not len(names):
        return None
    number = {t: i for i, t in enumerate(terms)}
    items = np.zeros((len(terms), len(names)), np.int32)
    for column, i in enumerate(names.tolist()):
        for t, c in counts[i].items():
            items[number[t], column] = c
    found = cut_lineage(bags(docs, vocabulary))
    n_docs, n_terms = found.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    frequency = np.zeros(len(terms), np.int64)
    for t, df in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the terms of the block
        frequency[t] = df
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
    m = (F.lit(75) + F.expr(f"(25 * n * {n_docs}L) div {n_terms}L")).alias("m")
    rows = found.where("doc_id is not null and size(terms) > 0").select("doc_id", m, "terms", "counts")
    bag = ["hash", "m", "terms", "counts"]
    rows = rows.withColumn("hash", F.xxhash64("m", "terms", "counts"))
    order = F.row_number().over(Window.partitionBy(*bag).orderBy("doc_id"))
    classes = rows.withColumn("_r", order).where(F.col("_r") <= k).groupBy(*bag).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    # each class is scored once, whatever tasks the grouping was dealt to
    best = scored(cut_lineage(classes.select("m", "terms", "counts", "ids")), weights, items, names, k)
    by = [F.desc("score"), F.asc("doc_id")]
    few = best.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("item_id", "_s").orderBy(*by))).where(F.col("_r") <= k).drop("_r", "_s")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*by))
    return few.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = 1_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    # a term takes a byte and a separator at least
    heavy = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(heavy / 2 / block_terms))
    out = items.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for b in range(n_blocks):
        texts: dict[int, list[str]] = {}
        for item_id, text in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).collect():
            texts.setdefault(item_id, []).append(text)
        found = search_block(docs, texts, k)
        out = out if found is None else found if n_blocks == 1 else out.union(found)
    return out
