"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}
#: Paths taken inside the innermost :func:`settled`.
_INSIDE: ContextVar[list[str] | None] = ContextVar("inside", default=None)


def build(app: str = "gaugeline", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators expect; cluster settings stay untouched."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where it is unset a session in local
    mode gets a temporary folder; on a cluster, whose executors do not share one, that is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="gaugeline-")
        atexit.register(shutil.rmtree, _LOCAL[context.applicationId], ignore_errors=True)
    return _LOCAL[context.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the scratch folder, remembered for :func:`drop_scratch`."""
    path = os.path.join(scratch_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    if (inside := _INSIDE.get()) is not None:
        inside.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove what this application has written below the scratch folder. DataFrames that read it are
    unusable afterwards, so call it when their results are stored."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them back, so that a lost executor
    costs a re-read and not the whole plan."""
    spark = df.sparkSession
    path = fresh_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``build()``, written once to the shared folder. What ``build`` wrote there on the way is
    deleted then, so a long step holds its result only; it must not hand out frames that read those files."""
    token = _INSIDE.set(passed := [])
    try:
        out = cut_lineage(build())
    finally:
        _INSIDE.reset(token)
    result, written = passed.pop(), _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in passed:
        _delete(spark, path)
        if path in written:
            written.remove(path)
    if (outer := _INSIDE.get()) is not None:
        outer.append(result)
    return out


def by_sort(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are shuffled. On its size as a compressed file
    Spark would often send it through the driver to every executor, where it is many times larger."""
    return df.hint("merge")
