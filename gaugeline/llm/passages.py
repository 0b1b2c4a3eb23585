"""Removing repeated passages by hashes of normalised units.

A unit is a line, cut at the ends of its sentences. It is normalised to its words in lower case and
hashed to 128 bits. Digests are grouped over all documents, with partial sums before the shuffle; the
occurrence first in rank (doc_id, then place) stays, every other one is marked. A marked stretch of
neighbouring units is removed when it holds at least ``min_words`` words, so short sentences that
many texts happen to share stay. Units of fewer than ``unit_words`` words are too common to be hashed;
they go only with the marked units around them. Spans refer to code points of the original text.

With ``run_words`` every run of that many words goes too that occurs in a document of smaller doc_id, or
earlier in the same text without overlap, wherever sentences and lines end; runs that overlap go as one,
so a passage goes to its last equal word. The smallest hash of the half-length word groups in a run, its
key, is the same wherever the run occurs; neighbouring runs with one key are a segment. A segment that
occurs as a whole in an earlier document goes at once. Over the corpus equal
means equal in two 64-bit hashes; which of its own runs a document loses is then told by the first one. Only where segments with one key differ, their
runs are hashed one by one, of each such segment in the first document that has it. That finds every
repeated run; what goes is the union of both kinds of spans.

Defined results: null and empty texts stay as they are; a text may become empty, its row stays; rows
that share a doc_id are one document, so they do not remove each other; a row without doc_id is
neither marked nor the first of anything; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm.blocks import LOWER, SPACE, Block, blocks, mixed, range_hashes, word_ranges
from gaugeline.session import by_sort, cut_lineage, settled

STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
ROLL = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: Words of a run that counts as a passage by itself.
RUN_WORDS = 50
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("words", T.IntegerType())]))


def units_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of all units (byte places, one more at the end), number of words of each unit, and the
    number of units before each text (one more at the end)."""
    data, bounds = block.data, block.bounds
    cut = data == 10
    cut[:-1] |= STOP[data[:-1]] & SPACE[data[1:]]
    edges = np.union1d(np.flatnonzero(cut) + 1, bounds)
    starts, _, _ = word_ranges(data, bounds)
    words = np.bincount(np.searchsorted(edges, starts, side="right") - 1, minlength=len(edges))[: max(0, len(edges) - 1)]
    return edges, words, np.searchsorted(edges, bounds)


def digests(block: Block, words: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each unit that has words, in order."""
    starts, ends, _ = word_ranges(block.data, block.bounds)
    one = range_hashes(LOWER[block.data], starts, ends)
    some = words[words > 0]
    if not len(some):
        return np.zeros((0, 2), np.int64)
    heads = np.cumsum(some) - some
    place = (np.arange(len(one)) - np.repeat(heads, some)).astype(np.uint64)
    sums = [np.add.reduceat(mixed(one + place * np.uint64(f)), heads) for f in ROLL]
    return np.column_stack(sums).view(np.int64)


def hashed_units(docs: DataFrame, unit_words: int) -> DataFrame:
    """(doc_id, unit, h1, h2) of all units with enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for block in blocks(batch.column("text")):
                edges, words, first = units_of(block)
                h = digests(block, words)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                number = np.arange(len(words)) - first[owner]
                some, enough = words > 0, words >= unit_words
                h = h[enough[some]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[block.first + owner[enough]]), pa.array(number[enough].astype(np.int32)), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["doc_id", "unit", "h1", "h2"])

    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    return known.mapInArrow(run, "doc_id bigint, unit int, h1 bigint, h2 bigint")


def marked_units(docs: DataFrame, unit_words: int) -> DataFrame:
    """(doc_id, units): the units of each document that occur earlier."""
    units = cut_lineage(hashed_units(docs, unit_words))
    place = F.struct("doc_id", "unit")
    repeated = units.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    # both sides grow with the input, and a digest that many texts hold is split as a skewed key
    found = units.join(by_sort(cut_lineage(repeated.select("h1", "h2", "first"))), ["h1", "h2"]).where(F.struct("doc_id", "unit") != F.col("first"))
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("unit")).alias("_units"))


def powers(factor: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, factor, np.uint64))


def rolled(one: np.ndarray, n: int, factor: int) -> np.ndarray:
    """64-bit hash of each group of ``n`` successive word hashes."""
    if len(one) < n:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(one * powers(factor, len(one)))])
    return mixed((sums[n:] - sums[:-n]) * powers(pow(factor, -1, 1 << 64), len(one) - n + 1))


def smallest(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each ``n`` successive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def runs_of(block: Block, run_words: int) -> tuple[np.ndarray, ...]:
    """Starts and ends of all words, their hashes, the number of words before each text, and place
    (number of its first word) and text of each run of ``run_words`` words."""
    starts, ends, first = word_ranges(block.data, block.bounds)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.flatnonzero(first[owner + 1] - np.arange(len(owner)) >= run_words)
    return starts, ends, range_hashes(LOWER[block.data], starts, ends), first, place, owner[place]


PAIR = np.dtype([("a", np.int64), ("b", np.int64)])


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """128-bit values from two 64-bit ones."""
    out = np.empty(len(a), PAIR)
    out["a"], out["b"] = a, b
    return out


def segments_of(one: np.ndarray, place: np.ndarray, owner: np.ndarray, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number (in ``place``) of the first run of each segment, its key, and two hashes of all its words."""
    n = max(1, run_words // 2)
    key = smallest(rolled(one, n, ROLL[0]), run_words - n + 1)[place]
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, PAIR)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    head = place[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    new |= (place - head) % run_words == 0  # so that a word said over and over gives more than one
    heads = np.flatnonzero(new)
    first, last = place[heads], place[np.append(heads[1:], len(key)) - 1] + run_words
    whole = []
    for factor in ROLL:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(one * powers(factor, len(one)))])
        whole.append(mixed((sums[last] - sums[first]) * powers(pow(factor, -1, 1 << 64), len(one))[first] + (last - first).astype(np.uint64)))
    return heads, key[heads].view(np.int64), paired((whole[1] ^ key[heads]).view(np.int64), whole[0].view(np.int64))


def run_segments(docs: DataFrame, run_words: int) -> DataFrame:
    """(doc_id, key, seg, seg2) of all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for block in blocks(batch.column("text")):
                _, _, one, _, place, owner = runs_of(block, run_words)
                heads, key, seg = segments_of(one, place, owner, run_words)
                yield pa.RecordBatch.from_arrays([pa.array(ids[block.first + owner[heads]]), pa.array(key), pa.array(seg["a"].copy()), pa.array(seg["b"].copy())], names=["doc_id", "key", "seg", "seg2"])

    return docs.mapInArrow(run, "doc_id bigint, key bigint, seg bigint, seg2 bigint")


def hashed_runs(docs: DataFrame, run_words: int) -> DataFrame:
    """(doc_id, h1, h2) of the runs in the segments ``open``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column("doc_id").to_numpy(), batch.column("open")
            for block in blocks(batch.column("text")):
                _, _, one, _, place, owner = runs_of(block, run_words)
                heads, _, seg = segments_of(one, place, owner, run_words)
                some = np.isin(seg["a"], wanted.slice(block.first, block.last - block.first).flatten().to_numpy())
                some = np.repeat(some, np.diff(np.append(heads, len(place))))
                h1, h2 = (rolled(one, run_words, f)[place[some]].view(np.int64) for f in ROLL)
                yield pa.RecordBatch.from_arrays([pa.array(ids[block.first + owner[some]]), pa.array(h1), pa.array(h2)], names=["doc_id", "h1", "h2"])

    return docs.mapInArrow(run, "doc_id bigint, h1 bigint, h2 bigint")


def marked_runs(docs: DataFrame, run_words: int) -> DataFrame:
    """(doc_id, _segs, _runs, _again): segments and runs of each document that a document before it has,
    and whether one of its texts may have a run twice."""
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    segments = cut_lineage(run_segments(known, run_words))
    kinds = segments.groupBy("key").agg(F.count("*").alias("n"), ((F.min("seg") != F.max("seg")) | (F.min("seg2") != F.max("seg2"))).alias("differ")).where("n > 1").select("key", "differ")
    shared = cut_lineage(segments.join(by_sort(cut_lineage(kinds)), "key"))
    first = shared.groupBy("seg", "seg2").agg(F.min("doc_id").alias("first"))
    shared = cut_lineage(shared.join(by_sort(cut_lineage(first)), ["seg", "seg2"]))
    opened = shared.where("differ and doc_id = first").groupBy("doc_id").agg(F.collect_set("seg").alias("open"))
    runs = cut_lineage(hashed_runs(known.join(by_sort(cut_lineage(opened)), "doc_id"), run_words))
    repeated = runs.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    later = runs.join(by_sort(cut_lineage(repeated.select("h1", "h2", "first"))), ["h1", "h2"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set("h1").alias("_runs"))
    whole = shared.where("doc_id > first").groupBy("doc_id").agg(F.collect_set("seg").alias("_segs"))
    again = shared.groupBy("doc_id", "key").count().where("count > 1").select("doc_id").distinct().withColumn("_again", F.lit(True))
    return whole.join(later, "doc_id", "full").join(again, "doc_id", "full")


def ranges(at: np.ndarray, run_words: int) -> list[tuple[int, int]]:
    """(first word, word after the last) of runs at the places ``at``, those that overlap or touch as one."""
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > run_words)
    return list(zip(at[np.append(0, gap + 1)].tolist(), (at[np.append(gap, len(at) - 1)] + run_words).tolist(), strict=True))


def occurred(place: np.ndarray, h: np.ndarray, run_words: int) -> np.ndarray:
    """Which runs of a text occur in it before, without overlap."""
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    return place >= place[first][of] + run_words


def stretches(words: np.ndarray, marked: np.ndarray, unit_words: int, min_words: int) -> list[tuple[int, int, int]]:
    """(first unit, unit after the last, words) of each marked stretch that is long enough."""
    out, at, n = [], 0, len(words)
    while at < n:
        if not marked[at]:
            at += 1
            continue
        end = after = at
        while after < n and (marked[after] or words[after] < unit_words):
            after += 1
            if marked[after - 1]:
                end = after
        total = int(words[at:end].sum())
        if total >= min_words:
            out.append((at, end, total))
        at = max(after, end, at + 1)
    return out


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, min_words: int = 25, unit_words: int = 4, run_words: int | None = None) -> DataFrame:
    """``docs`` with repeated passages removed from ``text`` and their spans in ``removed``; without
    ``run_words`` only stretches of whole units."""
    spark, none = docs.sparkSession, F.lit(None)
    marked = settled(spark, lambda: marked_units(docs, unit_words))
    marked = marked.join(settled(spark, lambda: marked_runs(docs, run_words)), "doc_id", "full") if run_words else marked.withColumns({"_segs": none.cast("array<bigint>"), "_runs": none.cast("array<bigint>"), "_again": none.cast("boolean")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n not in ("text", "removed", "_units", "_segs", "_runs", "_again")]
            for block in blocks(batch.column("text")):
                part = batch.slice(block.first, block.last - block.first)
                texts, marks = part.column("text").to_pylist(), part.column("_units").to_pylist()
                segs, runs, again = part.column("_segs"), part.column("_runs"), part.column("_again").to_pylist()
                spans: list[list[dict]] = [[] for _ in texts]
                some = [r is not None or segs[i].is_valid or runs[i].is_valid for i, r in enumerate(again)]
                edges, words, first = units_of(block) if any(marks) else (None, None, None)
                if any(some):
                    starts, ends, one, _, place, owner = runs_of(block, run_words)
                    heads, _, seg = segments_of(one, place, owner, run_words)
                    seg, h = np.repeat(seg["a"], np.diff(np.append(heads, len(place)))), rolled(one, run_words, ROLL[0])[place].view(np.int64)
                elif any(marks):
                    starts, _, _ = word_ranges(block.data, block.bounds)
                for i, units in enumerate(marks):
                    gone = []
                    if units:
                        own = words[first[i] : first[i + 1]]
                        mark = np.zeros(len(own), bool)
                        mark[[u for u in units if u < len(own)]] = True
                        gone = [(int(edges[first[i] + a]), int(edges[first[i] + b])) for a, b, _ in stretches(own, mark, unit_words, min_words)]
                    if some[i]:
                        own = slice(*np.searchsorted(owner, [i, i + 1]))
                        mark = np.zeros(len(place[own]), bool)
                        for values, hashes in ((seg[own], segs[i]), (h[own], runs[i])):
                            if hashes.is_valid:
                                mark |= np.isin(values, hashes.values.to_numpy())
                        if again[i]:
                            mark |= occurred(place[own], h[own], run_words)
                        gone += [(int(starts[a]), int(ends[b - 1])) for a, b in ranges(place[own][mark], run_words)]
                    if not gone:
                        continue
                    begin = int(block.bounds[i])
                    raw, keep, at = block.data[begin : int(block.bounds[i + 1])].tobytes(), [], 0
                    for a, b in united(gone):
                        n = int(np.searchsorted(starts, b) - np.searchsorted(starts, a))
                        a, b = a - begin, b - begin
                        spans[i].append({"start": len(raw[:a].decode("utf-8", "replace")), "end": len(raw[:b].decode("utf-8", "replace")), "words": n})
                        keep.append(raw[at:a])
                        at = b
                    texts[i] = b"".join([*keep, raw[at:]]).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())])))],
                    names=[*names, "text", "removed"])

    fields = {f.name: f for f in docs.schema.fields}
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"), "text", F.col("doc_id").cast("bigint").alias("_id"))
    joined = held.join(by_sort(marked.withColumnRenamed("doc_id", "_id")), "_id", "left").drop("_id")
    out = joined.mapInArrow(run, T.StructType([joined.schema["_row"], fields["text"], T.StructField("removed", SPAN)]))
    columns = [F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "removed"]
    return out.select(*columns, "removed")
