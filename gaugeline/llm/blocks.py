"""Texts of Arrow batches as byte arrays, for operators that work on many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 512 << 10  # numpy works on about 60 times as much at once

#: White space between words, and the shift of A-Z to a-z.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Block:
    """Rows ``first`` to ``last`` of a batch; text i is ``data[bounds[i]:bounds[i + 1]]``."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """A string column cut into runs of rows of about ``limit`` bytes; null counts as empty. A text
    longer than that is a block of its own."""
    column = pc.fill_null(column, "") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds, data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
    if len(column):
        bounds = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        if column.buffers()[2] is not None and column.buffers()[2].size:
            data = np.frombuffer(column.buffers()[2], np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1)
        own = bounds[first : last + 1]
        yield Block(first, last, data[own[0] : own[-1]], own - own[0])
        first = last


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the ranges, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """The first ``n`` of a fixed sequence of random 64-bit values."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE = numbers(256, 11)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: a sum of random byte values times random place values."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = ragged(starts, lengths)
    places = numbers(int(lengths.max()), 7)[ragged(np.zeros(len(lengths), np.int64), lengths)]
    return mixed(np.add.reduceat(BYTE[data[at]] * places, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


def word_ranges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of words before it (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)
