import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugeline.llm.blocks import blocks
from gaugeline.llm.bpe import decode, encode, load
from gaugeline.llm.packing import Rooms, best_fit_decreasing, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ("'s", "'t", "'re", "'ve", "'ll", "'", "''", " ", "  ", "\n", "\t", " \n", "a", "b", "Ab", "1", "23", "é", "ß", "日本", "🙂", "!", "?!", "<|endoftext|>", "<|", " ", "　",
         "'S", "'d ", "'m", "aaaa", "the", "_", "²", "´", "\r\n", "x's", "​", "ǆ", "Ⅷ", "¼", "́")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts_encode_and_decode_like_the_library(library):
    pick = random.Random(5)
    texts = ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 30))) for _ in range(4000)] + ["", None, "a" * 3000, " " * 70, "<|endoftext|>" * 3]
    bpe = load(PATH)
    for block in blocks(pa.array(texts), limit=5000):
        ids, bounds = bpe.encode(block)
        own = [t or "" for t in texts[block.first : block.last]]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [e.ids for e in library.encode_batch(own, add_special_tokens=False)]
        assert bpe.decode(ids.astype(np.int64), bounds) == own


def test_ids_that_cut_characters_decode_like_the_library(library):
    pick = random.Random(6)
    lists = [[pick.randrange(50257) for _ in range(pick.randint(0, 12))] for _ in range(500)]
    flat = np.array([i for x in lists for i in x], np.int64)
    assert load(PATH).decode(flat, np.cumsum([0] + [len(x) for x in lists])) == [library.decode(x, skip_special_tokens=False) for x in lists]
    with pytest.raises(ValueError):
        load(PATH).decode(np.array([60000]), np.array([0, 1]))


def test_memory_of_pieces_is_bounded_and_changes_nothing(monkeypatch, library):
    monkeypatch.setattr("gaugeline.llm.bpe.REMEMBERED", 3)
    texts = [f"some words {i} and more {i * i}" for i in range(50)]
    got = [ids.tolist() for block in blocks(pa.array(texts), limit=40) for ids, bounds in [load(PATH).encode(block)] if len(bounds) == 2]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_odd_rows(odd, empty, library):
    got = decode(encode(odd, PATH), PATH).collect()
    assert len(got) == odd.count() and all(r.decoded == (r.text or "") and r.ids == library.encode(r.text or "", add_special_tokens=False).ids for r in got)
    assert encode(empty, PATH).count() == 0
    nulls = odd.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert {r.decoded for r in decode(nulls, PATH).collect()} == {""}


def brute_best_fit(lengths, capacity):
    """The row with the least room that holds an item; of rows with equal room the one opened first."""
    rows, room = [], []
    for item, need in enumerate(lengths):
        fitting = [(r, i) for i, r in enumerate(room) if r >= need]
        if fitting:
            at = min(fitting)[1]
            rows[at].append(item)
            room[at] -= need
        else:
            rows.append([item])
            room.append(capacity - need)
    return rows


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_decreasing_against_brute_force(seed):
    pick = random.Random(seed)
    capacity = pick.choice([1, 7, 64, 100])
    lengths = sorted((pick.randint(1, capacity) for _ in range(300)), reverse=True)
    assert best_fit_decreasing(lengths, capacity) == brute_best_fit(lengths, capacity)


def test_rooms_find_the_smallest_that_holds():
    rooms = Rooms(20)
    for row, room in enumerate((5, 9, 9, 20)):
        rooms.add(room, row)
    assert [rooms.take(n) for n in (6, 6, 6, 6, 1, 1)] == [(9, 1), (9, 2), (20, 3), None, (5, 0), None]


def test_packed_rows_hold_every_token_once(odd, empty, library):
    rows = pack(odd, PATH, capacity=64, shard_bytes=20_000).collect()
    assert len({r.shard for r in rows}) > 1
    found = {}
    for r in rows:
        ids, positions, cut = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4"), r.cu_seqlens
        assert len(ids) == len(positions) == 64 and cut[0] == 0 and cut[-1] == r.n_tokens <= 64 and len(cut) == len(r.doc_ids) + 1
        assert (ids[r.n_tokens :] == 50256).all()
        for a, b, doc, piece in zip(cut, cut[1:], r.doc_ids, r.pieces, strict=False):
            assert positions[a:b].tolist() == list(range(b - a)) and (b - a == 64 or True)
            found.setdefault((doc, piece), []).append(ids[a:b].tolist())
    want = {}
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        for piece, a in enumerate(range(0, len(ids), 64)):
            want.setdefault((r.doc_id, piece), []).append(ids[a : a + 64])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert pack(empty, PATH).count() == 0


def test_a_repeated_id_and_a_long_text_are_spread(spark, library):
    text = " ".join(f"word{i}" for i in range(6000))
    docs = spark.createDataFrame([(7, f"{i} short text") for i in range(400)] + [(8, text)], "doc_id bigint, text string").coalesce(1)
    rows = pack(docs, PATH, capacity=64, shard_bytes=4000).collect()
    tokens = {}
    for r in rows:
        for d, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            tokens.setdefault(d, {}).setdefault(r.shard, 0)
            tokens[d][r.shard] += b - a
    for d, own in tokens.items():
        assert len(own) > 5 and max(own.values()) < sum(own.values()) / 3, d
    assert sum(tokens[8].values()) == len(library.encode(text, add_special_tokens=False).ids)
