"""Registry of queries: name -> (Spark callable, check SQL, what it covers)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.plans.views import SQL_VIEWS


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


QUERIES: dict[str, Query] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Output form shared with the check SQL: bigint counts, doubles rounded to 6 places."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            column = F.round(column.cast("double"), 6) + F.lit(0.0)
        out.append(column.alias(field.name))
    return df.select(*out)


def with_views(sql: str) -> str:
    """Put the needed view definitions in front of a statement as common table expressions."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(body)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in needed)
    rest = re.sub(r"^\s*WITH(\s+RECURSIVE)?\b", ",", sql, count=1, flags=re.I)
    return f"WITH RECURSIVE {ctes}\n{rest}"


def query(name: str, covers: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = Query(lambda spark, sf: tidy(fn(spark, sf)), with_views(sql) if sql else None, covers)
        return fn

    return register


def r6(expression: str) -> str:
    """SQL text that rounds like :func:`tidy`."""
    return f"(round(CAST({expression} AS DOUBLE), 6) + 0.0)"
