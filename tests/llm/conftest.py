import pytest
from pyspark.sql import functions as F

from llm_texts import prose

LONG = "\n".join(prose(900 + i, 300) for i in range(60))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, _row int, ids string, removed int, rep int, key string, shard int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing column names."""
    texts = [
        (1, prose(1, 120), "en", "a"), (2, prose(1, 120), "en", "a"), (2, prose(1, 120), "en", "a"), (3, prose(1, 119) + " other", "en", "b"), (4, "", "en", "b"), (5, None, None, None),
        (6, " \n\t ", "de", None), (7, LONG, "de", "b"), (8, "One two", "en", "a"), (9, "one TWO", "en", "c"), (None, prose(2, 80), "en", "c"), (10, prose(3, 60) + "\n" + prose(4, 40), None, "c"),
        (11, prose(5, 30) + "\n" + prose(4, 40), "fr", "c"), (12, prose(6, 70) + " é日本🙂 <|endoftext|> x's", "fr", "c"), (13, "a a a a a a b b b b", "fr", "c"),
    ]
    rows = [(i, t, l, s, None if t is None else len(t), "big", 1, "x", None, 3, "k", None) for i, t, l, s in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, F.col("source"))


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(1, 14)] + [(1, 1, 0), (None, 0, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
