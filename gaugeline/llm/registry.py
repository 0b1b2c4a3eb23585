"""Queries of the training-data operators: name -> (Spark callable, check SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("rules", "mixing", "topk", "warc", "bpe", "packing", "quality", "near_dups", "passages", "licences", "periods", "ranking", "jaccard")

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        FOUND[name] = (fn, sql)
        return fn

    return register


def load() -> None:
    for module in MODULES:
        import_module(f"gaugeline.llm.queries.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {name: fn for name, (fn, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {name: sql for name, (_, sql) in FOUND.items() if sql}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
