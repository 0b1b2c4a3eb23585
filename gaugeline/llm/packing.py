"""Packing token ids into rows of fixed length, best fit decreasing.

Pieces of documents are dealt to shards by a hash; the number of shards follows the amount of text, so a
shard stays within one task's memory at any size. Documents longer than a row are split without loss
into full rows and a rest; the pieces of one text, and texts with the same doc_id in a block, go to
shards of their own, so neither a very long document nor a repeated id fills one shard. In a shard the pieces, longest first, go into the open row with the least room
that still holds them; a segment tree over room sizes finds it in log(capacity) steps. A packed row
holds the ids, padded to the capacity, the cumulative lengths of its segments, and positions that
start again at 0 with each segment.

Defined results: documents without tokens are in no row; null or repeated doc_ids are documents of
their own; ties go to the row opened first; equal lengths go by doc_id, then piece, then content.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.bpe import load
from gaugeline.llm.blocks import blocks, ragged

PIECES = "doc_id bigint, piece int, again int, ids binary"  # ids in the narrowest integers that hold the vocabulary
PACKED = "shard int, row int, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, pieces array<int>"
ID = np.dtype("<u4")


def narrow(path: str) -> np.dtype:
    return np.dtype("<u2") if load(path).size <= 1 << 16 else ID


class Rooms:
    """Which sizes of room are open: a segment tree whose nodes tell whether any size below is."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << max(1, capacity).bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        heapq.heappush(self.rows.setdefault(room, []), row)
        at = room + self.leaves
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The smallest open room of at least ``need``, and the row opened first of those that have it."""
        at = need + self.leaves
        if not self.any[at]:
            while at > 1 and not (at % 2 == 0 and self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = heapq.heappop(self.rows[room])
        if not self.rows[room]:
            del self.rows[room]
            self.any[at] = 0
            while at > 1 and not (self.any[at] or self.any[at ^ 1]):
                at >>= 1
                self.any[at] = 0
        return room, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of item numbers; ``lengths`` in falling order, none above ``capacity``."""
    rooms, rows = Rooms(capacity), []
    for item, need in enumerate(lengths):
        found = rooms.take(need)
        if found is None:
            found = (capacity, len(rows))
            rows.append([])
        rows[found[1]].append(item)
        if found[0] > need:
            rooms.add(found[0] - need, found[1])
    return rows


def occurrence(values: np.ndarray) -> np.ndarray:
    """How often each value came before."""
    order = np.argsort(values, kind="stable")
    own = values[order]
    out = np.zeros(len(values), np.int64)
    out[order] = np.arange(len(own)) - np.searchsorted(own, own)
    return out


def tokenised(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """(doc_id, piece, again, ids) of all documents, cut at ``capacity`` ids; ``again`` numbers the texts of
    one id in a block."""
    kind = narrow(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for block in blocks(batch.column("text")):
                ids, bounds = bpe.encode(block)
                names = batch.column("doc_id").slice(block.first, block.last - block.first)
                again = occurrence(names.fill_null(0).to_numpy(zero_copy_only=False))
                number = -(-np.diff(bounds) // capacity)
                text = np.repeat(np.arange(len(number)), number)
                piece = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
                edges = np.append(bounds[:-1][text] + piece * capacity, bounds[-1])  # texts lie one after another
                data = pa.py_buffer(np.ascontiguousarray(ids, dtype=kind))
                column = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer((edges * kind.itemsize).astype(np.int32)), data])
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(text)), pa.array(piece.astype(np.int32)), pa.array(again[text].astype(np.int32)), column], names=["doc_id", "piece", "again", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECES)


def in_order(table: pa.Table, size: np.ndarray) -> np.ndarray:
    """Rows by falling size, then doc_id (null last), piece and content."""
    doc = table["doc_id"]
    none, name = doc.is_null().to_numpy(), doc.fill_null(0).to_numpy()
    piece = table["piece"].to_numpy()
    order = np.lexsort((piece, name, none, -size))
    keys = np.column_stack([-size, none, name, piece])[order]
    cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    heads, tails = np.append(0, cut), np.append(cut, len(order))
    for a, b in zip(heads[tails - heads > 1].tolist(), tails[tails - heads > 1].tolist(), strict=True):
        order[a:b] = sorted(order[a:b].tolist(), key=lambda i: table["ids"][i].as_py())
    return order


def pack(docs: DataFrame, path: str, capacity: int = 2048, pad_id: int = 50256, shard_bytes: int = 16 << 20) -> DataFrame:
    """Packed rows of all documents: see :data:`PACKED`. ``input_ids`` and ``position_ids`` are
    little-endian 4-byte integers, ``capacity`` of them; ``cu_seqlens`` starts at 0."""
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    shards = max(1, math.ceil(n_bytes / shard_bytes))
    kind = narrow(path)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        column = table["ids"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // kind.itemsize
        flat = np.frombuffer(column.buffers()[2], kind, count=int(edges[-1])) if edges[-1] else np.zeros(0, kind)
        order = in_order(table, np.diff(edges))
        size = np.diff(edges)[order]
        rows = best_fit_decreasing(size.tolist(), capacity)
        number = np.array([len(r) for r in rows], np.int64)
        item = np.array([i for r in rows for i in r], np.int64)
        first = np.cumsum(number) - number
        own = size[item]
        before = np.cumsum(own) - own
        start = before - np.repeat(before[first], number)  # of each segment in its row
        total = np.add.reduceat(own, first)
        place = ragged(np.repeat(np.arange(len(rows)), number) * capacity + start, own)
        ids = np.full(len(rows) * capacity, pad_id, ID)
        ids[place] = flat[ragged(edges[:-1][order[item]], own)]
        # the padding is a segment for itself
        tail = np.arange(len(rows)) * capacity + total
        position = np.zeros(len(rows) * capacity, ID)
        position[place] = ragged(np.zeros(len(own), np.int64), own)
        position[ragged(tail, capacity - total)] = ragged(np.zeros(len(rows), np.int64), capacity - total)
        cuts = np.zeros(len(own) + len(rows), np.int32)
        cuts[np.arange(len(own)) + np.repeat(np.arange(len(rows)), number) + 1] = start + own
        wide = (np.arange(len(rows) + 1) * capacity * ID.itemsize).astype(np.int64)
        rows_of = lambda data: pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(wide), pa.py_buffer(data)])
        lists = np.append(first, len(own)).astype(np.int32)
        picked = pa.array(order[item])
        return pa.Table.from_arrays(
            [pa.array(np.full(len(rows), key[0].as_py(), np.int32)), pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(total.astype(np.int32)), rows_of(ids).cast(pa.binary()),
             pa.ListArray.from_arrays(pa.array((lists + np.arange(len(rows) + 1)).astype(np.int32)), pa.array(cuts)), rows_of(position).cast(pa.binary()),
             pa.ListArray.from_arrays(pa.array(lists), table["doc_id"].combine_chunks().take(picked)), pa.ListArray.from_arrays(pa.array(lists), table["piece"].combine_chunks().take(picked))],
            names=["shard", "row", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "pieces"])

    shard = F.pmod(F.xxhash64("doc_id", "piece", "again", F.xxhash64("ids") * F.col("doc_id").isNull().cast("int")), F.lit(shards)).cast("int")
    return tokenised(docs, path, capacity).withColumn("shard", shard).drop("again").groupBy("shard").applyInArrow(run, PACKED)
