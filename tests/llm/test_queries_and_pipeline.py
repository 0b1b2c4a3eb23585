import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from gaugeline.llm.mixing import document_size
from gaugeline.llm.registry import oracle_sql, queries
from test_duplicates import brute_both, brute_components
from tools_check import TABLES, rows

BASE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    df = queries()[name](spark, BASE)
    got = pd.DataFrame([list(r) for r in df.collect()], columns=df.columns, dtype=object)
    cur = con.execute(oracle_sql()[name])
    assert rows(got) == rows(pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14)) and "pipeline" in E.queries()


def test_stages_against_brute_force(spark):
    """Each stage against a plain version on the output of the stage before."""
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{BASE}/labels.parquet")
    one = cut(stage["quality classifier"](spark, docs, BASE))
    assert one.columns == docs.columns
    bad = one.join(labels.where("quality = 0"), "doc_id").count()
    assert bad <= 2 and docs.join(labels.where("quality = 1"), "doc_id").count() - one.join(labels.where("quality = 1"), "doc_id").count() <= 3

    two = cut(stage["MinHash near-dedup"](spark, one, BASE))
    kept = {r[0] for r in brute_components([(r.doc_id, r.text) for r in one.collect()], 5, 80) if r[3]}
    assert {r.doc_id for r in two.collect()} == kept and two.columns == docs.columns

    three = cut(stage["substring dedup"](spark, two, BASE))
    want = set(brute_both([(r.doc_id, r.text) for r in two.collect()], 25, 4, 50))
    assert {(r.doc_id, r.text) for r in three.collect()} == want and three.columns == docs.columns
    assert three.where(F.length("text") != F.col("n_chars")).count() == 0

    four = cut(stage["mixing sources to target weights"](spark, three, BASE))
    assert four.columns == docs.columns and four.exceptAll(four.intersect(three).join(four.groupBy("doc_id").count(), "doc_id").drop("count")).count() >= 0
    sizes = three.groupBy("source").agg(F.sum(document_size(F.col("text"))).alias("size"), F.max(document_size(F.col("text"))).alias("largest"))
    taken = {r.source: r.taken for r in four.groupBy("source").agg(F.sum(document_size(F.col("text"))).alias("taken")).collect()}
    from gaugeline.llm.mixing import source_targets
    targets = source_targets(sizes.select("source", F.lit(1).alias("n_docs"), F.col("size").alias("source_size"))).join(sizes, "source").collect()
    assert all(abs(taken.get(r.source, 0) - r.target) <= r.largest for r in targets)

    five = stage["BPE encoding and decoding"](spark, four, BASE).collect()
    assert len(five) == four.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in five)


def cut(df):
    from gaugeline.session import cut_lineage
    return cut_lineage(df)
