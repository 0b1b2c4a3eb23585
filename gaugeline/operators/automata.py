"""Finite state machines over ordered rows by composed maps.

A row that is a step of a machine is a map from each state to the next one. Maps compose associatively, so
the maps of a stretch of rows become one map, whatever state it is entered in. Each key is cut into
chunks along its order; inside a chunk the composed map up to every row is found by doubling, for all
rows of a batch and all machines at once. One row per chunk goes on: composing those maps in order gives
the state each chunk is entered in, and a lookup gives the state at each row.

The rows are read and dealt once for any number of machines, latches and counters; a scan per running
value is not needed. Only the chunk maps of a key meet in one task, one small row for thousands.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.operators.scan import CHUNK
from gaugeline.session import cut_lineage


@dataclass(frozen=True)
class Automaton:
    """``table[symbol, state]`` is the next state; state 0 is the first one; ``labels`` name the states."""

    table: np.ndarray
    labels: tuple[str, ...]

    @staticmethod
    def of(first: Hashable, symbols: int, step: Callable[[Hashable, int], Hashable], label: Callable[[Hashable], str]) -> Automaton:
        """All states that can be reached from ``first``; at most 256."""
        number, rows, at = {first: 0}, [], 0
        while at < len(number):
            state = list(number)[at]
            rows.append([number.setdefault(step(state, s), len(number)) for s in range(symbols)])
            if len(number) > 256:
                raise ValueError("the machine has more than 256 states")
            at += 1
        return Automaton(np.array(rows, np.uint8).T.copy(), tuple(label(s) for s in number))


def boundaries(column: pa.Array) -> np.ndarray:
    """Whether each value of a struct column differs from the one before (the first does)."""
    new = np.zeros(len(column), bool)
    new[:1] = True
    for child in column.flatten():
        codes = child.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def composed(maps: np.ndarray, new: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """The maps of all rows since the last boundary as one map per row. ``maps`` is rows x machines x states;
    ``before`` is what leads to the first row if that is no boundary."""
    out = maps.copy()
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    reach = np.arange(len(new)) - head
    step, longest = 1, int(reach.max(initial=0))
    while step <= longest:
        rows = np.flatnonzero(reach >= step)
        out[rows] = np.take_along_axis(out[rows], out[rows - step], axis=2)
        step *= 2
    if before is not None and len(new) and not new[0]:
        open_ = int(np.argmax(new)) if new.any() else len(new)
        out[:open_] = np.take_along_axis(out[:open_], np.broadcast_to(before, out[:open_].shape), axis=2)
    return out


def along(batches: Iterator[pa.RecordBatch], group: str, maps_of: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch with the composed maps before and after each row, from rows in the order of ``group``."""
    last_group, last_map = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        maps = maps_of(batch)
        column = batch.column(group)
        new = boundaries(column)
        new[0] = last_map is None or column[0].as_py() != last_group
        after = composed(maps, new, last_map)
        earlier = np.empty_like(after)
        earlier[1:] = after[:-1]
        earlier[0] = 0 if last_map is None else last_map
        earlier[new] = np.arange(maps.shape[2], dtype=np.uint8)
        last_group, last_map = column[batch.num_rows - 1].as_py(), after[-1].copy()
        yield batch, earlier, after


def lists(values: np.ndarray) -> pa.Array:
    """Rows x anything as one list of small integers per row."""
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array((np.arange(len(flat) + 1) * flat.shape[1]).astype(np.int32)), pa.array(flat.ravel().astype(np.int16)))


MAP = T.ArrayType(T.ShortType())


def run(df: DataFrame, keys: list[str], order: list[str], chunk: Column, machines: dict[str, tuple[Automaton, Column]]) -> DataFrame:
    """``df`` with ``name`` (state after the row) and ``name_prev`` (state before it) for each machine
    ``name: (automaton, symbol)``. A NULL symbol is no step. ``order`` is a total order inside a key."""
    names = list(machines)
    width = max(len(a.labels) for a, _ in machines.values())
    tables = []
    for automaton, _ in machines.values():
        table = np.tile(np.arange(width, dtype=np.uint8), (len(automaton.table) + 1, 1))  # the last row is no step
        table[:-1, : automaton.table.shape[1]] = automaton.table
        tables.append(table)
    at = F.struct(*[F.col(k).alias(k) for k in keys], chunk.alias(CHUNK))
    symbols = F.array(*[F.coalesce(symbol, F.lit(len(automaton.table))).cast("short") for automaton, symbol in machines.values()])
    placed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), at.alias("_at"), F.struct(*order).alias("_order"), symbols.alias("_symbols"))
    placed = placed.repartition("_at").sortWithinPartitions("_at", "_order")

    def steps(batch: pa.RecordBatch) -> np.ndarray:
        symbol = batch.column("_symbols").flatten().to_numpy().reshape(-1, len(tables))
        return np.stack([table[symbol[:, m]] for m, table in enumerate(tables)], axis=1)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, earlier, after in along(batches, "_at", steps):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "_at", "_order")), lists(earlier), lists(after)], names=["_row", "_at", "_order", "_before", "_after"])

    fields = [placed.schema[c] for c in ("_row", "_at", "_order")]
    told = cut_lineage(placed.mapInArrow(inside, T.StructType([*fields, T.StructField("_before", MAP), T.StructField("_after", MAP)])))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda batch: batch.column("_after").flatten().to_numpy().astype(np.uint8).reshape(-1, len(tables), width)
        for batch, earlier, _ in along(batches, "_key", whole):
            yield pa.RecordBatch.from_arrays([batch.column("_at"), lists(earlier[:, :, 0])], names=["_at", "_start"])

    key = F.struct(*[F.col("_at")[k].alias(k) for k in keys]) if keys else F.struct(F.lit(0).alias("one"))
    chunks = told.groupBy("_at").agg(F.max_by("_after", "_order").alias("_after")).withColumn("_key", key)
    starts = chunks.repartition("_key").sortWithinPartitions("_key", F.col("_at")[CHUNK]).mapInArrow(across, T.StructType([told.schema["_at"], T.StructField("_start", MAP)]))
    joined = told.join(cut_lineage(starts), "_at")
    out = []
    for m, name in enumerate(names):
        labels = F.array(*[F.lit(x) for x in machines[name][0].labels])
        for column, source in ((name, "_after"), (f"{name}_prev", "_before")):
            out.append(F.get(labels, F.get(source, F.get("_start", m) + F.lit(m * width))).alias(column))
    kept = [c for c in df.columns if c not in {n for name in names for n in (name, f"{name}_prev")}]
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], *out)
