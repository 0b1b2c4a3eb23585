"""Exact n-gram Jaccard join in metric space.

A document is the set of its distinct word shingles; d = 1 - |intersection| / |union| is a metric, and two
documents link if d is at most r = 1 - percent / 100. Documents with equal sets are one class.

1. Territories. Two linked sets differ in a bounded number of shingles. Dealt to more parts by a hash,
   they agree in at least one whole part, so classes that share a part belong to one territory and no link
   leaves it; a document that shares none is farther than r from all others. Sets are compared in
   schemes by size; parts of fewer than :data:`LEAST` shingles are left out where enough others agree.
2. Regions. A territory of bounded size is joined in one task; distances to its first member rule out
   pairs whose difference exceeds r. A larger one draws pivots. The distances of all its members to them
   are exact; members within r of a pivot are linked with it. Those that are not linked with the largest
   part so far belong to the Voronoi region of their nearest pivot. If x is nearest to p, a member y
   linked with x has d(y, p) <= d(y, q) + 2r for every pivot q, and d(y, p) between the least and the
   largest distance of the region's members, widened by r: all such y are replicated into the region as
   its boundary. Regions join recursively until few own members are left, which are compared with
   all members of their region in chunks. A region that its pivots do not divide is dealt into blocks instead.
   Pairs are dropped only where the triangle inequality or an equal component makes them needless.
3. Links give components; every document gets the smallest doc_id it reaches.

Only part hashes of classes and the sets of documents in shared territories are shuffled.

Defined results: a text without words has an empty set and is linked with nothing; with fewer words than
a shingle the whole sequence is the set; rows that share a doc_id are one document with the links of
all its texts; a row without doc_id is linked with nothing and its component_id is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.blocks import blocks, mixed, numbers, ragged
from gaugeline.llm.joins import components, runs
from gaugeline.llm.near_dups import shingle_sets, with_sets
from gaugeline.session import cut_lineage

GROWTH = 1.2  # of sizes from scheme to scheme
LEAST = 3  # shingles of a part that counts
SMALL = 256  # own members of a region that ends the recursion
PIVOTS = 16
CHUNK_BYTES = 16 << 20  # of sets that one task compares with own members or pivots
SLACK = 1e-9


def schemes(largest: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each scheme the least size, the largest size, the number of parts and how many may be left out.

    The smaller of two linked sets has a size from ``low`` to below the next ``low``. With t the sum of
    sizes the sets differ in at most t (100 - percent) / (100 + percent) shingles."""
    low = [1]
    while low[-1] <= largest:
        low.append(max(low[-1] + 1, int(low[-1] * GROWTH)))
    low = np.array(low, np.int64)
    most = low[1:] - 1
    top = 100 * most // percent
    differ = (most + top) * (100 - percent) // (100 + percent)
    spare = differ // 10
    return low[:-1], top, differ + 1 + spare, spare


def part_keys(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """The hashes of the parts of each set (sorted distinct values), over all schemes its size is in."""
    size = np.array([len(s) for s in sets], np.int64)
    low, top, parts, spare = schemes(int(size.max(initial=0)), percent)
    own = np.searchsorted(low, size, side="right") - 1
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    value, heads = mixed(flat + np.uint64(1)), np.cumsum(size) - size
    found_set, found_key = [], []
    back = 0
    while True:
        some = np.flatnonzero((size > 0) & (own - back >= 0) & (size <= top[np.maximum(own - back, 0)])) if len(top) else np.zeros(0, np.int64)
        if not len(some):
            break
        scheme = own[some] - back
        m = parts[scheme]
        first = np.cumsum(m) - m
        at = ragged(heads[some], size[some])
        # sets are sorted, so the high half of a value gives ascending parts
        slot = np.repeat(first, size[some]) + (((flat[at] >> np.uint64(32)) * np.repeat(m, size[some]).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        total = np.zeros(int(m.sum()), np.uint64)
        total[slot[edge]] = np.add.reduceat(value[at], edge)
        count = np.zeros(len(total), np.int64)
        count[slot[edge]] = np.diff(edge, append=len(slot))
        owner = np.repeat(np.arange(len(some)), m)
        # parts that are left out are so in every set that has them; enough equal ones remain
        thin = count < LEAST
        out = np.bincount(owner[thin], minlength=len(some)) <= spare[scheme]
        keep = ~(thin & out[owner])
        name = mixed((scheme[owner].astype(np.uint64) << np.uint64(32)) + (np.arange(len(total)) - first[owner]).astype(np.uint64))
        found_set.append(some[owner[keep]])
        found_key.append(mixed(total[keep] ^ name[keep]) + count[keep].astype(np.uint64))
        back += 1
    if not found_set:
        return [np.zeros(0, np.uint64) for _ in sets]
    owner, key = np.concatenate(found_set), np.concatenate(found_key)
    order = np.argsort(owner, kind="stable")
    return np.split(key[order], np.searchsorted(owner[order], np.arange(1, len(sets))))


def keyed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, keys) of each document."""
    factors = numbers(2, 77) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                sets = shingle_sets(block, words)
                digests = [np.array([mixed(s * f).sum(dtype=np.uint64) for f in factors]).tobytes() for s in sets]
                keys = [k.tobytes() if len(k) else None for k in part_keys(sets, percent)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "keys"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, keys binary")


def spread_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rep, near): each key once a batch, with the other classes of the batch that have it."""
    for batch in batches:
        raw = [b"" if k is None else k for k in batch.column("keys").to_pylist()]
        key = np.frombuffer(b"".join(raw), np.uint64).view(np.int64)
        rep = np.repeat(batch.column("rep").to_numpy(), [len(k) // 8 for k in raw])
        order = np.lexsort((rep, key))
        key, rep = key[order], rep[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        again = ~new
        again[1:] &= rep[1:] != rep[:-1]
        near = np.cumsum(again)
        heads = np.flatnonzero(new)
        offsets = np.append(near[heads], near[-1] if len(near) else 0).astype(np.int32)
        empty = np.append(np.diff(offsets) == 0, False)
        lists = pa.ListArray.from_arrays(pa.array(offsets, mask=empty), pa.array(rep[again]))
        yield pa.RecordBatch.from_arrays([pa.array(key[heads]), pa.array(rep[heads]), lists], names=["key", "rep", "near"])


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from the first class of each key to all others, of rows in the order of keys."""
    last_key = last_rep = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, rep = batch.column("key").to_numpy(), batch.column("rep").to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = key[0] != last_key
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = np.where(head >= 0, rep[head], last_rep if last_rep is not None else 0)
        near = batch.column("near")
        sizes = np.where(near.is_valid().to_numpy(zero_copy_only=False), np.diff(near.offsets.to_numpy()), 0)
        a, b = np.concatenate([first[~new], np.repeat(first, sizes)]), np.concatenate([rep[~new], near.flatten().to_numpy()])
        both = np.unique(np.column_stack([a, b])[a != b], axis=0)
        last_key, last_rep = key[-1], first[-1]
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


class Overlaps:
    """Exact overlaps of sets with each other, over codes of their distinct values."""

    def __init__(self, raw: list[bytes], percent: int) -> None:
        sets = [np.frombuffer(r, np.uint64) for r in raw]
        self.percent, self.size = percent, np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        values, self.codes = np.unique(flat, return_inverse=True)
        self.heads, self.mark = np.cumsum(self.size) - self.size, np.zeros(len(values), np.int64)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.codes[self.heads[i] : self.heads[i] + self.size[i]]
        self.mark[own] = 1
        sizes = self.size[others]
        out = np.add.reduceat(self.mark[self.codes[ragged(self.heads[others], sizes)]], np.cumsum(sizes) - sizes) if len(others) else np.zeros(0, np.int64)
        self.mark[own] = 0
        return out

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        both = self.common(i, others)
        return 100 * both >= self.percent * (self.size[i] + self.size[others] - both)

    def distances(self, i: int) -> np.ndarray:
        both = self.common(i, np.arange(len(self.size)))
        return 1 - both / (self.size + self.size[i] - both)


def link_region(raw: list[bytes], own: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect whatever the links between ``own`` (places) and all members connect."""
    sets = Overlaps(raw, percent)
    size, part = sets.size, np.arange(len(raw))
    reach, out = 1 - percent / 100 + SLACK, []
    pivot = sets.distances(0) if len(raw) > 2 else np.zeros(len(raw))
    for i in own.tolist():
        near = (part != part[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])) & (np.abs(pivot - pivot[i]) <= reach)
        others = np.flatnonzero(near)
        hit = others[sets.linked(i, others)]
        if len(hit):
            out += [(i, j) for j in hit.tolist()]
            part[np.isin(part, part[hit])] = part[i]
    return out


def join_small(percent: int):
    """Links of whole territories, from rows in the order of territories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "root"):
            root, rep, items = table["root"].to_numpy(), table["rep"].to_numpy(), table["items"]
            heads = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
            edges = []
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(root)], strict=True):
                edges += [(a + i, a + j) for i, j in link_region(items.slice(a, b - a).to_pylist(), np.arange(b - a), percent)]
            both = rep[np.array(edges, np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def chunked(asked: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``asked`` (region, rep, items) beside every chunk of ``members`` (region, rep, items, chunks)."""
    # new names for the second use of the same table
    copies = asked.select(*[F.col(c).alias(c) for c in ("region", "rep", "items")], F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"))
    return copies, members.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("chunks")))


def join_chunk(percent: int):
    def run(own: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        raw = [*own["items"], *members["items"]]
        rep = np.concatenate([own["rep"].to_numpy(np.int64), members["rep"].to_numpy(np.int64)])
        edges = link_region(raw, np.arange(len(own)), percent) if len(own) and len(members) else []
        return pd.DataFrame([(int(rep[i]), int(rep[j])) for i, j in edges if rep[i] != rep[j]], columns=["a", "b"]).astype("int64")

    return run


MEASURED = "region bigint, rep bigint, own boolean, pivot boolean, label bigint, distances array<double>, edges array<bigint>"


def measure_chunk(percent: int):
    """Distances of members to the pivots in the order of their ids, links with them, and the smallest pivot of
    the group of linked pivots that a member is linked with."""

    def run(pivots: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(members):
            return pd.DataFrame({c.split()[0]: [] for c in MEASURED.split(", ")}).astype({"region": "int64", "rep": "int64", "own": "bool", "pivot": "bool", "label": "float64"})
        pivots = pivots.sort_values("rep")
        names, k = pivots["rep"].to_numpy(np.int64), len(pivots)
        sets = Overlaps([*pivots["items"], *members["items"]], percent)
        everyone = np.arange(len(sets.size))
        far = np.stack([sets.distances(i) for i in range(k)], axis=1)
        hit = np.stack([sets.linked(i, everyone) for i in range(k)], axis=1)
        group = np.arange(k)
        for _ in range(k):
            group = np.where(hit[:k], group[None, :], k).min(axis=1, initial=k)
        label = np.where(hit, names[group][None, :], np.iinfo(np.int64).max).min(axis=1)[k:]
        known = hit[k:].any(axis=1)
        out = members[["region", "rep", "own"]].copy()
        out["pivot"] = np.isin(out["rep"].to_numpy(), names)
        out["label"] = pd.array(np.where(known, label, 0), dtype="Int64")
        out.loc[~known, "label"] = pd.NA
        out["distances"] = list(far[k:])
        out["edges"] = [names[row] for row in hit[k:]]
        return out

    return run


def split_regions(measured: DataFrame, percent: int, round_no: int) -> DataFrame:
    """(region, rep, own) of the Voronoi regions of the next round."""
    reach = F.lit(1 - percent / 100 + SLACK)
    groups = measured.where("label is not null").groupBy("region", "label").count().groupBy("region").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rows = measured.where("not pivot").join(groups, "region", "left")
    nearest = F.array_min("distances")
    rows = rows.withColumns({"nearest": nearest, "open": F.col("own") & ~F.coalesce(F.col("label") == F.col("main"), F.lit(False))})
    # ties go to any of the nearest pivots, so that equal distances divide a region too
    tied = F.filter(F.sequence(F.lit(0), F.size("distances") - 1), lambda i: F.get("distances", i) == F.col("nearest"))
    rows = rows.withColumn("home", F.when(F.col("open"), F.get(tied, F.pmod(F.xxhash64("rep", F.lit(round_no)), F.size(tied)).cast("int"))))
    rows = cut_lineage(rows.select("region", "rep", "distances", "nearest", "home"))
    parts = rows.where("home is not null").groupBy("region", "home").agg(F.count("*").alias("n"), F.min("nearest").alias("low"), F.max("nearest").alias("high"))
    whole = Window.partitionBy("region")
    parts = parts.withColumn("undivided", (F.col("n") > SMALL) & (2 * F.col("n") > F.sum("n").over(whole)))
    parts = parts.withColumn("blocks", F.when(F.col("undivided"), F.ceil(F.col("n") / SMALL)).otherwise(1))
    # at most one entry for each pivot
    parts = cut_lineage(parts.groupBy("region").agg(F.collect_list(F.struct("home", "low", "high", "blocks")).alias("parts")))
    at = lambda p: F.get("distances", p["home"])
    inside = lambda p: (at(p) <= p["high"] + reach) & (at(p) >= p["low"] - reach) & (at(p) <= F.col("nearest") + 2 * reach)
    spread = rows.join(parts, "region").withColumn("p", F.explode(F.filter("parts", lambda p: inside(p) | (F.col("home") == p["home"]))))
    mine = F.coalesce(F.col("home") == F.col("p.home"), F.lit(False))
    spread = spread.withColumn("mine", mine).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("p.blocks") - 1)))
    block = F.pmod(F.xxhash64("rep", F.lit(round_no + 1000)), F.col("p.blocks"))
    return spread.select(F.xxhash64("region", "p.home", "block", F.lit(round_no)).alias("region"), "rep", (F.col("mine") & (F.col("block") == block)).alias("own"))


def join_large(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside territories ``members`` (root, rep, items) of any size."""
    sets = members.select("rep", "items")
    state = members.select(F.col("root").alias("region"), "rep", F.lit(True).alias("own"))
    found, round_no = [], 0
    while True:
        held = state.join(sets, "rep").select("region", "rep", "own", "items")
        sizes = held.groupBy("region").agg(F.count_if("own").alias("n_own"), F.ceil(F.sum(F.octet_length("items")) / CHUNK_BYTES).alias("chunks"))
        held = cut_lineage(held.join(cut_lineage(sizes), "region"))
        few, many = held.where(F.col("n_own") <= SMALL), held.where(F.col("n_own") > SMALL)
        own, rest = chunked(few.where("own"), few)
        found.append(cut_lineage(own.groupBy("region", "chunk").cogroup(rest.groupBy("region", "chunk")).applyInPandas(join_chunk(percent), "a bigint, b bigint")))
        if many.isEmpty():
            break
        round_no += 1
        drawn = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("rep", F.lit(round_no)), "rep"))
        pivots, rest = chunked(many.where("own").withColumn("_r", drawn).where(F.col("_r") <= PIVOTS), many)
        measured = cut_lineage(pivots.groupBy("region", "chunk").cogroup(rest.groupBy("region", "chunk")).applyInPandas(measure_chunk(percent), MEASURED))
        found.append(measured.select(F.col("rep").alias("a"), F.explode("edges").alias("b")).where("a <> b"))
        state = split_regions(measured, percent, round_no)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90, small: int = SMALL) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    every = cut_lineage(keyed(docs, words, percent))
    classes = cut_lineage(
        every.where("n_shingles > 0 and doc_id is not null").groupBy("digest", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most"), F.count("*").alias("n_rows"), F.first("keys").alias("keys")))
    rows = classes.select("rep", "keys").mapInArrow(spread_keys, "key bigint, rep bigint, near array<bigint>")
    near = rows.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(stars, "a bigint, b bigint")
    territories = components(near).withColumnRenamed("v", "rep")
    sizes = territories.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    wanted = cut_lineage(territories.join(sizes, "root").select("rep", "root", "n"))
    few, many = wanted.where(F.col("n") <= small), wanted.where(F.col("n") > small)
    links = with_sets(docs, cut_lineage(few), words).drop("n").repartition("root").sortWithinPartitions("root", "rep").mapInArrow(join_small(percent), "a bigint, b bigint")
    if not many.isEmpty():
        links = links.union(join_large(cut_lineage(with_sets(docs, cut_lineage(many), words).drop("n")), percent))
    # rows that share a doc_id link the classes of their texts
    several = every.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg((F.min("digest") != F.max("digest")).alias("differ")).where("differ").select("doc_id")
    bridges = every.join(several, "doc_id").join(classes.select("digest", "n_shingles", "rep"), ["digest", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.union(bridges))
    lowest = found.join(found.groupBy("root").agg(F.min("v").alias("component_id")), "root").select(F.col("v").alias("rep"), "component_id")
    told = classes.select("digest", "n_shingles", "rep", "most", "n_rows").join(cut_lineage(lowest), "rep", "left")
    told = told.select("digest", "n_shingles", "most", "n_rows", F.coalesce("component_id", "rep").alias("component_id")).where("most <> component_id")
    largest = told.agg(F.max("n_rows")).first()[0] or 1
    salts = math.ceil(largest / 1_000_000)  # a class of any size is joined in parts of bounded size
    told = told.select("digest", "n_shingles", "component_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = every.select("doc_id", "n_shingles", "digest", F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).alias("salt"))
    out = rows.join(told, ["digest", "n_shingles", "salt"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
