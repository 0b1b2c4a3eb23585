import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeline.llm import jaccard
from gaugeline.llm.blocks import mixed
from gaugeline.llm.jaccard import jaccard_components, link_region, part_keys, schemes
from test_duplicates import brute_components


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute(rows, words, percent):
    return sorted((r[:3] for r in brute_components(rows, words, percent)), key=repr)


@given(st.integers(1, 120), st.integers(1, 20), st.sampled_from([50, 70, 80, 90, 95]), st.randoms(use_true_random=False))
@settings(max_examples=400, deadline=None)
def test_linked_sets_share_a_part(size, changed, percent, random):
    pool = mixed(np.arange(1, size + 2 * changed + 1, dtype=np.uint64) * np.uint64(random.randrange(1, 2**40)))
    one = pool[:size]
    other = np.concatenate([one[random.randrange(changed + 1) :], pool[size : size + random.randrange(changed + 1)]])
    one, other = np.unique(one), np.unique(other)
    if len(other) and 100 * len(np.intersect1d(one, other)) >= percent * len(np.union1d(one, other)):
        a, b = part_keys([one, other], percent)
        assert len(np.intersect1d(a, b))


def test_schemes_cover_all_sizes():
    for percent in (50, 80, 90, 99):
        low, top, parts, spare = schemes(5000, percent)
        assert low[0] == 1 and (np.diff(low) > 0).all() and low[-1] <= 5000 < top[-1] + 1 and (parts > spare).all()


@pytest.mark.parametrize("small", [256, 1])
def test_odd_rows(odd, empty, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(jaccard_components(odd, small=small)) == brute(rows, 3, 90)
    assert jaccard_components(empty).count() == 0


def test_rows_that_share_an_id(spark):
    long = " ".join(f"a{i}" for i in range(50))
    rows = [(2, long), (5, long), (5, "quite another text of words"), (7, "quite another text of words"), (8, "else"), (None, long), (9, "two words"), (10, "TWO words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(jaccard_components(docs)) == brute(rows, 3, 90)


@pytest.mark.parametrize("small, pivots, percent", [(256, 16, 70), (4, 3, 70), (1, 2, 70), (6, 2, 90)])
def test_chain_star_and_dense_groups(spark, monkeypatch, small, pivots, percent):
    """Regions with boundaries: chains of neighbours, stars about a base, and groups just beyond the threshold."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 20_000)
    base = [f"s{i}" for i in range(300)]
    star = [" ".join(w if (i + 11 * k) % 31 else f"x{k}" for i, w in enumerate(base)) for k in range(40)]
    chain = [" ".join(f"c{i}" for i in range(8 * k, 8 * k + 200)) for k in range(12)]
    rng = np.random.default_rng(5)
    group = [" ".join(f"g{i}" if rng.random() > p else f"y{rng.integers(9)}" for i in range(120)) for p in (0.005, 0.01, 0.02, 0.04) for _ in range(25)]
    rows = [(1000 + i, t) for i, t in enumerate(star)] + [(999, " ".join(base))] + [(i, t) for i, t in enumerate(chain)] + [(500 + i, t) for i, t in enumerate(chain[:3] + group)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert got(jaccard_components(docs, percent=percent, small=small)) == brute(rows, 3, percent)


def test_a_shared_passage_links_nothing(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, f"{passage} " + " ".join(f"k{k}_{i}" for i in range(3 * k))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(jaccard_components(docs)) == brute(rows, 3, 90)


def test_links_connect_what_all_links_connect():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(60)]
    for own in (np.arange(60), np.arange(0, 60, 7)):
        edges = link_region([s.tobytes() for s in sets], own, 60)
        linked = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))
        assert all(linked(i, j) for i, j in edges)
        part = np.arange(60)
        for i, j in edges:
            part[part == part[j]] = part[i]
        assert all(part[i] == part[j] for i in own for j in range(60) if linked(i, j))
