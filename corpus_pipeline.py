"""A training corpus from ``documents``: quality, near duplicates, repeated passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.bpe import round_trip
from gaugeline.llm.mixing import mix
from gaugeline.llm.near_dups import deduplicated
from gaugeline.llm.passages import RUN_WORDS, without_repeats
from gaugeline.llm.quality import accepted
from gaugeline.session import settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return deduplicated(docs, words=5)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier; n_chars follows the text."""
    kept = without_repeats(docs, run_words=RUN_WORDS)
    kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its shards."""
    return mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether these decode to the text."""
    encoded = round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", passage_dedup),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", token_ids),
]

#: The classifier and the tokenizer are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
