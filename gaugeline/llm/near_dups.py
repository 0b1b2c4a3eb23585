"""Near-duplicate components by a chosen-path set similarity join.

A document is the set of its distinct word shingles (64-bit hashes); two documents are linked if
100 * intersection >= percent * union. Documents with equal sets are one class from the start.

1. Each class gets a signature of minwise values. In every tree a node draws coordinates (1 / threshold
   on average) and sends a class to the child named by the coordinate's minwise token, so a pair at the
   threshold keeps one common child on average and pairs below it thin out level by level. Nodes with
   at most ``small`` members are compared exhaustively by signature; larger ones compare all members
   with a few hubs, then with the few that no hub joined to the rest, and branch again where many are left. Nodes
   with the same members, which repeat from tree to tree, are compared once. Trees are independent;
   a pair at the threshold is missed by all of them with a probability far below one in a million.
2. Candidate edges are star-shaped and joined to candidate components.
3. Inside a candidate component links are confirmed on the full sets. A component of bounded size is
   searched breadth-first in one task, where joined members need no further comparison. A larger one
   is split over tasks: rounds of pivots are compared with all members, until every member is joined
   to the largest part or has been a pivot itself, which leaves no pair undecided.

Only ids, signatures and the sets of candidates are shuffled; a full text is read twice.

Defined results: a text without words has an empty set and is linked with nothing; with fewer words
than a shingle the whole sequence is the set; rows that share a doc_id are one document; a row
without doc_id is linked with nothing, its component_id is null and it is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.blocks import LOWER, Block, blocks, mixed, numbers, range_hashes, word_ranges
from gaugeline.llm.joins import components, join_ids, runs
from gaugeline.session import cut_lineage, settled

WIDTH = 64  # coordinates of a signature
MISS = 2e-6  # chance that a pair at the threshold has fewer equal coordinates than a candidate needs
HUBS = 32
PIVOTS, PIVOT_BYTES = 1024, 32 << 20  # of one component and round
FACTORS = numbers(WIDTH, 101) | np.uint64(1)


def shingle_sets(block: Block, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = LOWER[block.data]
    starts, ends, at = word_ranges(data, block.bounds)
    one = range_hashes(data, starts, ends)
    factor = numbers(words, 55) | np.uint64(1)
    windows = np.zeros(max(0, len(one) - words + 1), np.uint64)
    for j in range(words if len(windows) else 0):
        windows = windows * np.uint64(31) + mixed(one[j : j + len(windows)] * factor[j])
    windows = mixed(windows)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(windows[a : b - words + 1]))
        elif b > a:  # the whole sequence, told apart from shingles by its length
            whole = np.array([b - a], np.uint64)
            for j in range(b - a):
                whole = mixed(whole * np.uint64(31) + one[a + j : a + j + 1] * factor[j])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(values: np.ndarray) -> np.ndarray:
    out = np.full(WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(values), 1 << 15):
        out = np.minimum(out, (values[a : a + (1 << 15), None] * FACTORS).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


SIGNED = "doc_id bigint, n_shingles bigint, digest binary, sig binary"


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, signature) of each document."""
    digest_factors = numbers(2, 77) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                sets = shingle_sets(block, words)
                digests = [np.array([mixed(s * f).sum(dtype=np.uint64) for f in digest_factors]).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                     pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SIGNED)


def drawn(key: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates that nodes draw: the first always, the second (or -1) so often that
    100 / percent are drawn on average."""
    a = mixed(key ^ np.uint64(0x5BD1E995))
    first, second = (a % np.uint64(WIDTH)).astype(np.int64), ((a >> np.uint64(20)) % np.uint64(WIDTH - 1)).astype(np.int64)
    second += second >= first
    return first, np.where((a >> np.uint64(40)) % np.uint64(percent) < np.uint64(100 - percent), second, -1)


def children(key: np.ndarray, sig: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of nodes and signatures: row number and key of every child."""
    rows, keys = [], []
    for salt, at in enumerate(drawn(key, percent)):
        row = np.flatnonzero(at >= 0)
        value = sig[row, at[row]].astype(np.uint64)
        rows.append(row)
        keys.append(mixed(mixed(key[row] + np.uint64(salt + 1)) ^ mixed(value * np.uint64(WIDTH) + at[row].astype(np.uint64))))
    return np.concatenate(rows), np.concatenate(keys)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, WIDTH)


def branches(members: DataFrame, percent: int, trees: int | None = None) -> DataFrame:
    """(key, rep, label) of the children of ``members`` (rep, sig and, below the roots, key and label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, rep = matrix(batch.column("sig")), batch.column("rep").to_numpy()
            nodes = [batch.column("key").to_numpy().view(np.uint64)] if trees is None else [np.full(len(rep), k) for k in numbers(trees, 909)]
            label = batch.column("label").to_numpy() if trees is None else rep
            for node in nodes:
                row, key = children(node, sig, percent)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rep[row]), pa.array(label[row])], names=["key", "rep", "label"])

    return members.mapInArrow(run, "key bigint, rep bigint, label bigint")


def groups_of(links: np.ndarray) -> np.ndarray:
    """The smallest member joined to each member, from a symmetric matrix of links."""
    root = np.arange(len(links))
    while True:
        low = np.where(links, root, len(links)).min(axis=1, initial=len(links))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def least_equal(percent: int) -> int:
    """Equal coordinates that a candidate pair needs: fewer have a chance below :data:`MISS` at the threshold."""
    p, total = percent / 100, 0.0
    for t in range(WIDTH):
        total += math.comb(WIDTH, t) * p**t * (1 - p) ** (WIDTH - t)
        if total > MISS:
            return t
    return WIDTH


def likely(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Whether signatures (last axis) are those of a candidate pair."""
    return (a == b).sum(axis=-1) >= least


def small_nodes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Star edges between candidate pairs inside each node, all pairs compared."""
    for table in runs(batches, "key"):
        key, rep, sig = table["key"].to_numpy(), table["rep"].to_numpy(), matrix(table["sig"])
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(heads, append=len(key))
        edges = []
        pairs = heads[sizes == 2]
        pairs = pairs[likely(sig[pairs], sig[pairs + 1], least)]
        edges.append(np.column_stack([rep[pairs], rep[pairs + 1]]))
        for at, size in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = sig[at : at + size]
            root = groups_of(np.stack([likely(own, row, least) for row in own]))
            member = np.flatnonzero(root != np.arange(size))
            edges.append(np.column_stack([rep[at + root[member]], rep[at + member]]))
        both = np.concatenate(edges)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def hub_chunk(hubs: pd.DataFrame, members: pd.DataFrame, least: int) -> pd.DataFrame:
    """Labels of a node's members after comparing them with its hubs, and the edges found."""
    if not len(members):
        return pd.DataFrame({"key": [], "rep": [], "label": [], "edges": []}).astype({"key": "int64", "rep": "int64", "label": "int64"})
    hubs = hubs.sort_values("rep")
    h, m = matrix(pa.array(hubs["sig"])), matrix(pa.array(members["sig"]))
    names, reps = hubs["rep"].to_numpy(), members["rep"].to_numpy()
    root = groups_of(np.stack([likely(h, row, least) for row in h]))
    hit = np.stack([likely(m, row, least) for row in h], axis=1)
    by_group = np.zeros_like(hit)
    for j, r in enumerate(root):
        by_group[:, r] |= hit[:, j]
    first_hit = {r: np.where(hit & (root == r), np.arange(len(h)), len(h)).min(axis=1) for r in set(root.tolist())}
    edges = [[] for _ in reps]
    for r, first in first_hit.items():
        for i in np.flatnonzero(by_group[:, r]).tolist():
            edges[i].append(int(names[first[i]]))
    place = {int(n): j for j, n in enumerate(names)}
    for i, rep in enumerate(reps.tolist()):  # a hub is tied to the hubs it is linked with
        if rep in place:
            edges[i] += names[likely(h, h[place[rep]], least)].tolist()
    label = np.where(by_group.any(axis=1), names[np.argmax(by_group, axis=1)], members["label"].to_numpy())
    return pd.DataFrame({"key": members["key"].to_numpy(), "rep": reps, "label": label, "edges": edges})


def split(rows: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Members of the nodes worth a comparison: of small nodes, one for each set of members, and of large."""
    fold = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"f{i}") for i in (1, 2)]
    nodes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), *fold).where("n > 1 and lo <> hi")
    nodes = cut_lineage(nodes.groupBy("n", "f1", "f2").agg(F.min("key").alias("key")).select("key", "n"))
    members = cut_lineage(rows.join(nodes, "key"))
    return members.where(F.col("n") <= small), members.where(F.col("n") > small)


def compared(hubs: DataFrame, members: DataFrame, least: int, chunk: int) -> DataFrame:
    """Members (key, rep, label, sig, n) against the hubs of their node, in chunks of bounded size."""
    chunks = F.ceil(F.col("n") / chunk)
    # new names for the second use of the same table
    names = [F.col(c).alias(c) for c in ("key", "rep", "sig")]
    asked = hubs.select(*names, F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("chunk"))
    dealt = members.select("key", "rep", "label", "sig", F.pmod(F.xxhash64("rep"), chunks).alias("chunk"))
    return asked.groupBy("key", "chunk").cogroup(dealt.groupBy("key", "chunk")).applyInPandas(lambda h, m: hub_chunk(h, m, least), "key bigint, rep bigint, label bigint, edges array<bigint>")


def candidates(reps: DataFrame, percent: int, trees: int, small: int, chunk: int = 4096) -> DataFrame:
    """Candidate edges (a, b) between classes ``reps`` (rep, sig).

    After its hubs a large node has a largest part, all joined, and the rest. At most ``small`` rest
    members are compared with the whole node, which finishes it; with more it branches."""
    least = least_equal(percent)
    few, many = split(cut_lineage(branches(reps, percent, trees)), small)
    found = []
    edges = lambda df: df.select(F.col("rep").alias("a"), F.explode("edges").alias("b")).where("a <> b")
    while True:
        near = few.select("key", "rep").join(reps, "rep").repartition("key").sortWithinPartitions("key", "rep")
        found.append(cut_lineage(near.mapInArrow(lambda batches: small_nodes(batches, least), "a bigint, b bigint")))
        if many.isEmpty():
            break
        large = cut_lineage(many.join(reps, "rep"))
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("key", "rep"), "rep"))
        told = cut_lineage(compared(large.withColumn("_rank", rank).where(F.col("_rank") <= HUBS), large, least, chunk))
        found.append(edges(told))
        parts = told.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.sum("m").alias("n"), F.max("m").alias("m"), F.max_by("label", F.struct("m", "label")).alias("main"))
        parts = cut_lineage(parts.where("m < n").select("key", "n", "main", (F.col("n") - F.col("m") <= small).alias("last")))
        left = cut_lineage(told.select("key", "rep", "label").join(parts, "key").join(reps, "rep"))
        last = left.where("last")
        found.append(edges(cut_lineage(compared(last.where("label <> main"), last, least, chunk))))
        few, many = split(cut_lineage(branches(left.where("not last").select("key", "rep", "label", "sig"), percent)), small)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


class Sets:
    """Many sets in one array of codes, for intersections of one set with all of them."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        self.values, self.codes = np.unique(flat, return_inverse=True)
        self.heads = np.cumsum(self.size) - self.size

    def linked(self, one: np.ndarray, percent: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.values, one), len(self.values) - 1)
        mark = np.zeros(len(self.values), np.int64)
        mark[at[self.values[at] == one]] = 1
        common = np.add.reduceat(mark[self.codes], self.heads)
        return 100 * common >= percent * (self.size + len(one) - common)


def confirm(percent: int):
    """Breadth-first search of whole candidate components: (rep, root) by true links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "root"):
            group, rep = table["root"].to_numpy(), table["rep"].to_numpy()
            raw = table["items"]
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            out = rep.copy()
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(rep)], strict=True):
                sets = [np.frombuffer(x, np.uint64) for x in raw.slice(a, b - a).to_pylist()]
                everything, apart = Sets(sets), np.ones(b - a, bool)
                for i in range(b - a):
                    if not apart[i]:
                        continue
                    apart[i], queue, part = False, [i], [i]
                    while queue and apart.any():
                        near = np.flatnonzero(everything.linked(sets[queue.pop()], percent) & apart).tolist()
                        apart[near] = False
                        queue += near
                        part += near
                    out[[a + j for j in part]] = min(int(rep[a + j]) for j in part)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(out)], names=["rep", "root"])

    return run


def pivot_chunk(percent: int):
    """Edges of a chunk's members to the pivots they are linked with, one for each group of pivots."""

    def run(pivots: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(members) and len(pivots):
            sets, heads = [np.frombuffer(x, np.uint64) for x in members["items"]], [np.frombuffer(x, np.uint64) for x in pivots["items"]]
            rep, names = members["rep"].to_numpy(), pivots["rep"].to_numpy()
            among, everything = Sets(heads), Sets(sets)
            root = groups_of(np.stack([among.linked(s, percent) for s in heads]))
            hit = np.stack([everything.linked(s, percent) for s in heads], axis=1)
            for r in set(root.tolist()):
                first = np.where(hit & (root == r), np.arange(len(heads)), len(heads)).min(axis=1)
                out += [(int(rep[i]), int(names[first[i]])) for i in np.flatnonzero(first < len(heads))]
            out += [(int(names[j]), int(names[r])) for j, r in enumerate(root)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def confirm_large(members: DataFrame, percent: int, chunk: int = 512) -> DataFrame:
    """(rep, root) by true links in candidate components ``members`` (root, rep, n, items) of any size."""
    labels = cut_lineage(members.select(F.col("root").alias("part"), "rep", F.col("rep").alias("label"), F.lit(False).alias("asked"), F.octet_length("items").alias("size")))
    edges = None
    while True:
        sizes = labels.groupBy("part", "label").count()
        largest = sizes.groupBy("part").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        order = Window.partitionBy("part").orderBy(F.xxhash64("rep"), "rep")
        few = labels.join(largest, "part").where("not asked and label <> main").withColumn("_o", F.row_number().over(order)).where(F.col("_o") <= PIVOTS)
        heavy = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
        pivots = cut_lineage(few.withColumn("_b", heavy).where((F.col("_o") == 1) | (F.col("_b") <= PIVOT_BYTES)).select("part", "rep"))
        if pivots.isEmpty():
            return labels.groupBy("label").agg(F.min("rep").alias("least")).join(labels, "label").select("rep", F.col("least").alias("root"))
        held = members.join(pivots.select("rep"), "rep", "left_semi")
        chunks = F.ceil(F.col("n") / chunk)
        # new names for the second use of the same table
        ask = held.select(*[F.col(c).alias(c) for c in ("root", "rep", "items")], F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("chunk"))
        dealt = members.join(pivots.select(F.col("part").alias("root")).distinct(), "root", "left_semi").select("root", "rep", "items", F.pmod(F.xxhash64("rep"), chunks).alias("chunk"))
        found = ask.groupBy("root", "chunk").cogroup(dealt.groupBy("root", "chunk")).applyInPandas(pivot_chunk(percent), "a bigint, b bigint")
        edges = cut_lineage(found if edges is None else edges.union(found))
        roots = components(edges).withColumnRenamed("v", "rep")
        asked = pivots.select("rep", F.lit(True).alias("now"))
        labels = cut_lineage(labels.join(roots, "rep", "left").join(asked, "rep", "left").select("part", "rep", F.coalesce("root", "rep").alias("label"), (F.col("asked") | F.coalesce("now", F.lit(False))).alias("asked"), "size"))


def with_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``wanted`` (rep and more) with ``items``, the shingle set of the document rep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != "text"]
            for block in blocks(batch.column("text")):
                part = batch.slice(block.first, block.last - block.first)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array([s.tobytes() for s in shingle_sets(block, words)], pa.binary())], names=[*names, "items"])

    texts = join_ids(docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text"), wanted, "rep", "inner")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != "text")
    return texts.mapInArrow(run, f"{schema}, items binary")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, trees: int = 12, small: int = 256) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    every = cut_lineage(signed(docs, words))
    classes = cut_lineage(
        every.where("n_shingles > 0 and doc_id is not null").groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most"), F.first("sig").alias("sig")))
    reps = classes.select("rep", "sig")
    parts = components(candidates(reps, percent, trees, small)).withColumnRenamed("v", "rep")
    sizes = parts.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    wanted = cut_lineage(parts.join(sizes, "root").select("rep", "root", "n"))
    few, many = wanted.where(F.col("n") <= small), wanted.where(F.col("n") > small)
    confirmed = with_sets(docs, cut_lineage(few), words).drop("n").repartition("root").sortWithinPartitions("root", "rep").mapInArrow(confirm(percent), "rep bigint, root bigint")
    if not many.isEmpty():
        confirmed = confirmed.union(confirm_large(cut_lineage(with_sets(docs, cut_lineage(many), words)), percent))
    joined = classes.select("digest", "n_shingles", "rep", "most").join(cut_lineage(confirmed.distinct()), "rep", "left")
    told = joined.select("digest", "n_shingles", "most", "rep", F.coalesce("root", "rep").alias("component_id")).where("most <> component_id")
    salts = 8  # a class may hold a third of all rows
    told = told.select("digest", "n_shingles", "component_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    told = told.groupBy("digest", "n_shingles", "salt").agg(F.min("component_id").alias("component_id"))
    rows = every.select("doc_id", "n_shingles", "digest", F.when(F.col("doc_id").isNotNull(), F.pmod("doc_id", F.lit(salts)).cast("int")).alias("salt"))
    out = rows.join(told, ["digest", "n_shingles", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id."""
    gone = settled(docs.sparkSession, lambda: near_duplicates(docs, **settings).where("not kept").select("doc_id").distinct())
    return join_ids(docs, gone, "doc_id", "left_anti")
