import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeline.llm.periods import periodic_runs, runs_of
from gaugeline.llm.queries.periods import op12_periodic_runs, with_planted
from test_queries_and_pipeline import BASE


def brute_runs(words, exponent=4, least=6):
    """Every period by comparing all words at that distance."""
    ids = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    out, n = [], len(ids)
    for q in range(1, n // exponent + 1):
        equal = np.concatenate([[0], (ids[q:] == ids[:-q]).astype(int), [0]])
        edge = np.flatnonzero(np.diff(equal))
        for a, b in edge.reshape(-1, 2).tolist():
            size = b - a + q
            stretch = ids[a : a + size]
            if size >= max(least, exponent * q) and not any((stretch[d:] == stretch[:-d]).all() for d in range(1, q)):
                out.append((a, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_in(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, text):
    words = words_in(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=6))
@settings(max_examples=300, deadline=None)
def test_runs_of_small_alphabets(texts):
    first = np.cumsum([0, *map(len, texts)])
    flat = np.array([w for t in texts for w in t], np.uint64)
    start, length, period = runs_of(flat, first, 4, 6)
    want = [(int(first[i]) + a, n, q) for i, t in enumerate(texts) for a, n, q in brute_runs(t)]
    assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == want


@given(st.integers(1, 9), st.integers(4, 9), st.integers(0, 3), st.integers(2, 5), st.randoms())
@settings(max_examples=200, deadline=None)
def test_nested_runs(period, times, extra, outer, random):
    block = [random.randrange(4) for _ in range(period)] * times + [7] * extra
    words = np.array(block * outer + block[: random.randrange(len(block))], np.uint64)
    got = runs_of(words, np.array([0, len(words)]), 3, 3)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == brute_runs(words, 3, 3)


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in op12_periodic_runs(spark, BASE).collect()}
    rows = spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = 0
    for doc_id, text in rows:
        words = planted(doc_id, text)
        runs = brute_runs(words)
        r = got[doc_id]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()
        some += bool(runs)
    assert some > 10


def test_odd_rows(spark, odd, empty):
    out = periodic_runs(odd.withColumn("runs", odd.rep)).collect()
    assert len(out) == odd.count()
    for r in out:
        words = words_in(r.text)
        runs = brute_runs(words)
        assert [tuple(x) for x in r.runs] == runs and r.collapsed == brute_collapsed(words, runs)
    assert {tuple(x) for r in out if r.doc_id == 13 for x in r.runs} == {(0, 6, 1)}
    assert periodic_runs(empty).count() == 0
    assert with_planted(odd).where("doc_id is null").count() == 1


def test_long_text(spark):
    words = [f"w{i % 90_000}" for i in range(370_000)]
    docs = spark.createDataFrame([(1, " ".join(words) + " end")], "doc_id bigint, text string")
    row = periodic_runs(docs).first()
    assert [tuple(x) for x in row.runs] == [(0, 370_000, 90_000)] and row.collapsed == " ".join([*words[:90_000], "end"])


def test_least_exponent(odd):
    with pytest.raises(ValueError):
        periodic_runs(odd, exponent=2)
