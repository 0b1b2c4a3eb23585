"""Periodic runs of words by a dictionary of basic factors.

A basic factor is a stretch of 2^k words. Factors are named level by level: the name of a factor of
2^k words is the number of the pair of names of its halves, so equal names mean equal words. At each
level every factor looks at its successor, the next place in the same text where it occurs. Successors
at a distance q of at most twice the length lie in arithmetic progressions of difference q; neighbouring
places with the same distance propose period q from the first place to the end of the last successor.

A run of smallest period q and at least 3q words shows at the level with 2^(k-1) < q <= 2^k as
one stretch of distance q over its whole extent, for if a factor of q words or more came again
sooner inside the run, both distances would be periods of more than their sum of words and the
run would have a smaller period. So of the distances up to twice the length those of the upper half of
the length are taken at each level, each run is proposed once, and its first and last word follow
from the stretch. Only factors that occur twice in their text go to the next level, which leaves few
places of a text without repetition, and levels end at a quarter of the words (the least exponent).

All texts of a block are worked on in one flat array; no row is shuffled.

Defined results: null, empty and blank texts have no runs and an empty collapsed text; every row is
a text by itself, also with a null or repeated doc_id; a text longer than a block is a block of its
own, with about 200 bytes of memory a word; columns of ``docs`` named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm.blocks import blocks, ragged, range_hashes, word_ranges

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
ARROW_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


def successors(name: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance from each place to the next one with the same name (0: none), and whether its name comes twice."""
    order = np.argsort(name, kind="stable")  # places ascend within a name
    same = name[order[1:]] == name[order[:-1]]
    distance, twice = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    distance[order[:-1][same]] = (at[order[1:]] - at[order[:-1]])[same]
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    return distance, twice


def runs_of(words: np.ndarray, first: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, starts counted over all texts; ``words`` are the hashes of all
    words and text i has those from ``first[i]`` to ``first[i + 1]``."""
    found = []
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    end, most = np.repeat(first[1:], n), np.repeat(n // exponent, n)
    at = np.arange(len(words))
    name = np.unique(words, return_inverse=True)[1] + owner * len(words)
    length = 1
    while len(at):
        distance, twice = successors(name, at)
        right = np.flatnonzero((2 * distance > length) & (distance <= length))
        if len(right):
            place, period = at[right], distance[right]
            cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(period) != 0))
            heads, tails = np.append(0, cut + 1), np.append(cut, len(place) - 1)
            start, period = place[heads], period[heads]
            size = place[tails] + length + period - start
            long = size >= np.maximum(least, exponent * period)
            found.append(np.column_stack([start, size, period])[long])
        # longer factors: both halves occur twice, the text has room, and its longest period is not yet reached
        keep = np.full(len(words) + 1, -1, np.int64)
        keep[at[twice]] = np.unique(name[twice], return_inverse=True)[1]
        at = at[twice]
        at = at[(at + 2 * length <= end[at]) & (most[at] > length)]
        at = at[keep[at + length] >= 0]
        name = keep[at] * (len(words) + 1) + keep[at + length]
        length *= 2
    out = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    out = out[np.lexsort((out[:, 2], out[:, 0]))]
    return out[:, 0], out[:, 1], out[:, 2]


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray, first: np.ndarray) -> pa.Array:
    """For each text its words ``kept`` (a mask), joined by one space."""
    lengths = (ends - starts)[kept]
    heads = np.cumsum(lengths + 1) - (lengths + 1)
    out = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    out[ragged(heads, lengths)] = data[ragged(starts[kept], lengths)]
    before = np.concatenate([[0], np.cumsum(kept)])[first]  # kept words before each text
    edge = np.append(heads, len(out))[before]
    last = before[1:] > before[:-1]
    drop = np.zeros(len(out), bool)
    drop[edge[1:][last] - 1] = True  # the space after a text's last word
    offsets = np.concatenate([[0], np.cumsum(np.diff(edge) - last)])
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[~drop])])


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """``docs`` with ``runs``, all stretches of consecutive words with a smallest period q and at least
    ``exponent`` * q and ``least`` words that no neighbouring word extends, by start and period, and
    ``collapsed``, the words joined by one space without those after the first q words of a run."""
    if exponent < 3:
        raise ValueError("runs are found from three times their period")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                starts, ends, first = word_ranges(block.data, block.bounds)
                at, size, period = runs_of(range_hashes(block.data, starts, ends), first, exponent, least)
                gone = np.zeros(len(starts) + 1, np.int64)
                np.add.at(gone, at + period, 1)
                np.add.at(gone, at + size, -1)
                text = joined_words(block.data, starts, ends, np.cumsum(gone)[:-1] == 0, first)
                own = np.searchsorted(first[1:], at, side="right")
                rows = pa.StructArray.from_arrays([pa.array(at - first[own]), pa.array(size), pa.array(period)], fields=list(ARROW_RUN))
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(first))).astype(np.int32)), rows)
                part = batch.slice(block.first, block.last - block.first)
                yield pa.RecordBatch.from_arrays([part.column("_row"), runs, text.cast(pa.string())], names=["_row", "runs", "collapsed"])

    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    out = held.mapInArrow(run, T.StructType([held.schema["_row"], T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("runs", "collapsed")], "runs", "collapsed")
