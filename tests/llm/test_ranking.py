import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gaugeline.llm.ranking import Vocabulary, ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranked(docs, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        asked = Counter(t for text in {x for i, x in items if i == item and x is not None} for t in terms(text))
        scores = []
        for doc_id, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // n_terms
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, c in asked.items() if t in b)
            if score > 0 and doc_id is not None:
                scores.append((-score, doc_id))
        out += [(item, rank, doc_id, -s) for rank, (s, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return out


def got(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_odd_rows(spark, odd, empty):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "w7 W14 one two, TWO"), (2, "w7"), (2, "w7"), (2, "a b é日本"), (3, ""), (4, None), (None, "w7"), (5, "unknown"), (6, "日本🙂 x")]
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1)).withColumn("score", F.lit("x"))
    want = brute_ranked(texts, items)
    assert got(ranked(odd, asked)) == want and {r[0] for r in want} == {1, 2, 6}
    assert got(ranked(odd, asked, block_terms=3)) == want
    assert got(ranked(odd, asked, k=2)) == brute_ranked(texts, items, 2)
    assert got(ranked(empty, asked)) == [] and got(ranked(odd, asked.limit(0))) == []


def test_many_copies_and_ties(spark):
    docs = [(i, "alpha beta") for i in range(300, 0, -1)] + [(1000 + i, f"alpha beta gamma{i % 7} " + "delta " * (i % 5)) for i in range(400)]
    items = [(1, "alpha"), (2, "gamma3 alpha"), (3, "delta delta beta")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    assert got(ranked(frame, spark.createDataFrame(items, "item_id bigint, text string"))) == brute_ranked(docs, items)


def test_hits_are_proved_by_their_bytes():
    vocabulary, names = Vocabulary.of(["alpha", "beta"])
    data = np.frombuffer(b"beta gamma alpha", np.uint8)
    starts, ends = np.array([0, 5, 11]), np.array([4, 10, 16])
    at = vocabulary.find(data, starts, ends).tolist()
    assert [names[i] if i >= 0 else None for i in at] == ["beta", None, "alpha"]
    vocabulary.data = vocabulary.data[::-1]
    assert vocabulary.find(data, starts, ends).tolist() == [-1, -1, -1]
