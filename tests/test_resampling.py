"""Hashed draws in pieces: the same numbers as one md5 per draw, over many tasks."""

import hashlib
import random
from collections import Counter

import numpy as np

from gaugeline.functions.digests import first_words
from gaugeline.operators import resampling as R


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def test_first_words_are_those_of_md5():
    heads = [f"7:x{b}:" for b in (0, 5, 10, 999, 1000)] + ["é" * 30 + ":", ""]
    tails = [str(i) for i in (0, 9, 10, 12345, 99999999)]
    assert first_words(heads, tails).tolist() == [[number(h + t) for t in tails] for h in heads]


def test_sampled_sign_flips_are_dealt_and_repeatable(spark):
    diffs = [random.Random(3).gauss(0.2, 1) for _ in range(50)]
    got = R.sign_flips(spark.createDataFrame(list(enumerate(diffs)), "i long, d double"), "d", "i", "sampled", draws=1200).first()
    sums = [sum(d if number(f"20260920:{m}:{i}") % 2 == 0 else -d for i, d in enumerate(diffs)) for m in range(1200)]
    assert got.n_perm == 1200 and not got.exact
    assert abs(got.p_two_sided - np.mean([abs(s) >= abs(sum(diffs)) - 1e-10 for s in sums])) < 1e-12


def test_bootstrap_sums_over_several_ranges_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "RANGE", 8), monkeypatch.setattr(R, "DRAWS", 5), monkeypatch.setattr(R, "REPLICATES", 3)
    size = {"a": 21, "b": 4}
    rows = [(s, i, float(i * i) - 3, 1) for s, n in size.items() for i in range(n)] + [(None, 0, 1e9, 1)]
    df = spark.createDataFrame(rows, "s string, pos long, v double, one int")
    got = {r.replicate: (r.v, r.one) for r in R.bootstrap_sums(df, "s", "pos", ["v", "one"], 7, 11).collect()}
    for b in range(7):
        drawn = [number(f"11:{s}:{b}:{i}") % n for s, n in size.items() for i in range(n)]
        assert got[b] == (sum(float(p * p) - 3 for p in drawn), 25)
    pieces = R._drawn(spark.createDataFrame(list(size.items()), "s string, n long"), "s", "n", 7, 11)
    assert pieces.rdd.getNumPartitions() == 3 * (5 + 1)  # no task draws for all


def test_dose_bootstrap_weighs_each_device_as_often_as_it_is_drawn(spark, monkeypatch):
    seen = []
    fits = R.logistic_fits
    monkeypatch.setattr(R, "logistic_fits", lambda points, keys, *more: seen.append(points) or fits(points, keys, *more, rounds=1))
    monkeypatch.setattr(R, "RANGE", 8)
    rows = [(i, 1.0 + i, i > 9) for i in range(20)]
    R.bootstrap_ed50(spark.createDataFrame(rows, "pos long, v double, hit boolean"), "v", "hit", "pos", replicates=6)
    times = Counter()
    for r in seen[0].collect():
        times[r.replicate, round(10**r._x - 1), r._y] += r._times
    assert times == Counter((b, p, float(p > 9)) for b in range(6) for p in (number(f"20260918:{b}:{i}") % 20 for i in range(20)))
