"""Byte-level BPE: encoding by batched merge rounds, decoding by table.

Texts of a block are cut into pieces on code-point classes, equal pieces are encoded once. The symbols
of all new pieces lie in one flat array; in each round every piece finds its lowest-ranked pair (rank
by binary search over the sorted pair keys), merges all its occurrences from the left, and only
pairs next to a merge are looked up again. Encoded pieces are remembered up to a fixed number.

The file is that of the tokenizers library (byte-level, no normaliser); its path is a parameter and
must exist on every machine. Added tokens are found in texts as the library does by default.

Defined results: a null or empty text has no ids and decodes to the empty text; null ids decode to
the empty text; bytes that are no UTF-8 are replaced as the library does; an id that the file does not
have is an error; columns of the input are kept, ``ids`` and ``decoded`` are replaced if they exist.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gaugeline.llm.blocks import Block, blocks, ragged, range_hashes

REMEMBERED = 300_000
NONE = np.iinfo(np.int32).max
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Fixed values of the piece pattern: endings after an apostrophe that are pieces of their own.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
#: Code points with the property White_Space.
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        out[cp] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[list(WHITE)] = SPACE
    return out


def byte_characters() -> dict[str, int]:
    """The visible character that stands for each byte: itself where printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Tables of one tokenizer file."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        vocab, chars = spec["model"]["vocab"], byte_characters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = np.zeros(256, np.int32)
        for char, byte in chars.items():
            self.first[byte] = vocab[char]
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        left, right, into = np.array(pairs, np.int64).reshape(-1, 3).T
        keys = (left << 32) | right
        order = np.argsort(keys)
        self.keys, self.rank, self.into = keys[order], order.astype(np.int32), into[order].astype(np.int32)
        by_id = {i: t.encode() for t, i in self.added.items()} | {i: bytes(chars[c] for c in t) for t, i in vocab.items()}
        self.size = max(by_id) + 1
        tokens = [by_id.get(i, b"") for i in range(self.size)]
        self.token_length = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Known pieces by ascending hash: their bytes, for the proof that a hit is one, and their ids."""
        self.known = {n: np.zeros(0, np.uint64 if n == "hash" else np.int64) for n in ("hash", "byte", "length", "start", "count")}
        self.known_bytes, self.known_ids = np.zeros(0, np.uint8), np.zeros(0, np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the sorted keys, or -1."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte strings that lie one after another: flat ids and their number per string."""
        symbols, owner = self.first[data], np.repeat(np.arange(len(lengths)), lengths)
        done_ids, done_owner = [], []
        pair = np.full(len(symbols), -1)
        inner = owner[:-1] == owner[1:]
        pair[:-1][inner] = self.ranks(symbols[:-1][inner], symbols[1:][inner])
        while len(symbols):
            rank = np.where(pair >= 0, self.rank[pair], NONE)
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            sizes = np.diff(heads, append=len(owner))
            least = np.minimum.reduceat(rank, heads)
            if (least == NONE).any():  # these strings are finished
                open_ = np.repeat(least != NONE, sizes)
                done_ids.append(symbols[~open_]), done_owner.append(owner[~open_])
                symbols, owner, pair, rank = symbols[open_], owner[open_], pair[open_], rank[open_]
                least, sizes = least[least != NONE], sizes[least != NONE]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            # of overlapping occurrences (a a a) the left one wins: every second of a run of neighbours
            run = np.cumsum(np.diff(at, prepend=-2) != 1)
            first_of_run = np.flatnonzero(np.diff(run, prepend=0))
            at = at[(np.arange(len(at)) - first_of_run[run - 1]) % 2 == 0]
            symbols[at] = self.into[pair[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, owner, pair = symbols[keep], owner[keep], pair[keep]
            at = moved[at]
            beside = np.zeros(len(symbols) + 1, bool)
            beside[at] = beside[at - 1] = True  # -1 is the spare place
            again = np.flatnonzero(beside[:-1])
            last = again == len(symbols) - 1
            pair[again[last]] = -1
            again = again[~last]
            inner = owner[again] == owner[again + 1]
            pair[again[~inner]] = -1
            again = again[inner]
            pair[again] = self.ranks(symbols[again], symbols[again + 1])
        ids, owner = np.concatenate([*done_ids, np.zeros(0, np.int32)]), np.concatenate([*done_owner, np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(lengths))

    def pieces(self, text: str, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of each piece in code points, and its added token's id or -1. No piece crosses ``breaks``."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.zeros(len(points) + 1, bool)
        edge[breaks], edge[-1] = True, True
        spans = []
        for token, number in self.added.items():
            at = text.find(token)
            while at >= 0:
                if not edge[at + 1 : at + len(token)].any():
                    spans.append((at, at + len(token), number))
                at = text.find(token, at + len(token))
        for a, b, _ in spans:
            edge[[a, b]] = True
        kind = classes()[points]
        run = edge[:-1].copy()
        run[1:] |= kind[1:] != kind[:-1]
        blank = kind == SPACE
        joined = np.zeros(len(points), bool)  # the character before is a plain space of the same part
        joined[1:] = (points[:-1] == 0x20) & ~edge[1:-1]
        start = run & (blank | ~joined)
        start[:-1] |= blank[:-1] & ~blank[1:] & ~edge[1:-1]
        for i in np.flatnonzero(start & run & (points == 0x27)).tolist():
            for ending in ENDINGS:
                end = i + 1 + len(ending)
                if text.startswith(ending, i + 1) and not edge[i + 1 : end].any():
                    start[i + 1] = False
                    if end < len(points):
                        start[end] |= kind[end] == LETTER
                    break
        special = np.full(len(points), -1, np.int64)
        for a, b, number in spans:
            start[a], start[a + 1 : b], special[a] = True, False, number
        at = np.flatnonzero(start)
        return at, special[at]

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts of a block, and where each text's ids begin (one more at the end)."""
        if not len(block.data):
            return np.zeros(0, np.int32), np.zeros(len(block.bounds), np.int64)
        text = block.data.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.concatenate([[0], np.cumsum(width)])
        at, special = self.pieces(text, np.searchsorted(place, block.bounds[:-1][np.diff(block.bounds) > 0]))
        starts = place[at]
        ends = np.append(starts[1:], len(block.data))
        lengths = ends - starts
        hashes, first, same = np.unique(range_hashes(block.data, starts, ends), return_index=True, return_inverse=True)
        if (lengths != lengths[first][same]).any() or (block.data != block.data[ragged(starts[first][same], lengths)]).any():
            raw = block.data.tobytes()  # two pieces share a hash: tell them apart by their bytes
            number: dict[bytes, int] = {}
            same = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            first = np.unique(same, return_index=True)[1]
            hashes = range_hashes(block.data, starts[first], ends[first])
            order = np.argsort(hashes, kind="stable")
            hashes, first, same = hashes[order], first[order], np.argsort(order)[same]
        flat, count = self.remembered(block.data, starts[first], ends[first], hashes)
        begin = np.cumsum(count) - count
        if (special >= 0).any():
            flat = np.concatenate([flat, special[special >= 0].astype(np.int32)])
            begin = np.append(begin, np.arange(len(flat) - (special >= 0).sum(), len(flat)))
            count = np.append(count, np.ones((special >= 0).sum(), np.int64))
            same = same.copy()
            same[special >= 0] = np.arange(len(begin) - (special >= 0).sum(), len(begin))
        ids = flat[ragged(begin[same], count[same])]
        ahead = np.concatenate([[0], np.cumsum(count[same])])
        return ids, ahead[np.searchsorted(starts, block.bounds)]

    def remembered(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for different pieces, from memory where they were met before."""
        if len(self.known["hash"]) > REMEMBERED:
            self.forget()
        known, lengths = self.known, ends - starts
        at = np.searchsorted(known["hash"], hashes)
        slot = np.minimum(at, max(0, len(known["hash"]) - 1))
        hit = np.zeros(len(hashes), bool)
        if len(known["hash"]):
            hit = (known["hash"][slot] == hashes) & (known["length"][slot] == lengths)
            some = np.flatnonzero(hit)
            if len(some):
                other = data[ragged(starts[some], lengths[some])] != self.known_bytes[ragged(known["byte"][slot[some]], lengths[some])]
                hit[some] = np.add.reduceat(other, np.cumsum(lengths[some]) - lengths[some]) == 0
        new, old = np.flatnonzero(~hit), slot[hit]
        raw = data[ragged(starts[new], lengths[new])]
        ids, count = self.merge(raw, lengths[new])
        total = np.zeros(len(hashes), np.int64)
        total[hit], total[new] = known["count"][old], count
        flat, begin = np.empty(int(total.sum()), np.int32), np.cumsum(total) - total
        flat[ragged(begin[hit], total[hit])] = self.known_ids[ragged(known["start"][old], total[hit])]
        flat[ragged(begin[new], count)] = ids
        # a piece whose hash belongs to another one is not remembered
        free = np.ones(len(new), bool)
        if len(known["hash"]):
            free = known["hash"][slot[new]] != hashes[new]
        free[1:] &= hashes[new][1:] != hashes[new][:-1]
        rows = {"hash": hashes[new], "byte": len(self.known_bytes) + np.cumsum(lengths[new]) - lengths[new], "length": lengths[new], "start": len(self.known_ids) + np.cumsum(count) - count, "count": count}
        self.known = {n: np.insert(known[n], at[new][free], rows[n][free]) for n in known}
        self.known_bytes, self.known_ids = np.concatenate([self.known_bytes, raw]), np.concatenate([self.known_ids, ids])
        return flat, total

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is not in the tokenizer file")
        length = self.token_length[ids]
        raw = self.token_bytes[ragged(self.token_start[ids], length)].tobytes()
        at = np.concatenate([[0], np.cumsum(length)])[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def replaced(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], names=[*names, name])


def with_field(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the token ids of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for block in blocks(batch.column(text)):
                ids, bounds = bpe.encode(block)
                yield replaced(batch.slice(block.first, block.last - block.first), "ids", pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))

    return docs.mapInArrow(run, with_field(docs, "ids", T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                column = part.column(ids).fill_null([]) if part.column(ids).null_count else part.column(ids)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
                yield replaced(part, "decoded", pa.array(bpe.decode(flat, bounds), pa.string()))

    return encoded.mapInArrow(run, with_field(encoded, "decoded", T.StringType()))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``round_trip``, whether decoding them gives the text back; both in one pass,
    so neither ids nor decoded texts travel once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for block in blocks(batch.column(text)):
                part = batch.slice(block.first, block.last - block.first)
                ids, bounds = bpe.encode(block)
                decoded = bpe.decode(ids.astype(np.int64), bounds)
                same = [d == (t or "") for d, t in zip(decoded, part.column(text).to_pylist(), strict=True)]
                part = replaced(part, "ids", pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
                yield replaced(part, "round_trip", pa.array(same, pa.bool_()))

    schema = [f for f in docs.schema.fields if f.name not in ("ids", "round_trip")]
    return docs.mapInArrow(run, T.StructType([*schema, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]))
