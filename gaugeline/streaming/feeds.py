"""File feeds, idempotent upserts and windowed aggregates under Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeline.session import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_feed(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, glob: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Stream of new files in a folder; the schema is given, never inferred."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def snapshot_feed(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Snapshot lines as a stream of parsed snapshots; broken lines have no ``things``."""
    from gaugeline.sources.snapshots import SCHEMA

    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(F.from_json("value", SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("_j")).select("_j.*")


def run_available(stream: DataFrame, each_batch: Callable[[DataFrame, int], None], mode: str = "append", label: str = "stream", checkpoint: str | None = None) -> None:
    """Drain what is there now in micro-batches. Offsets and state live in ``checkpoint``: a query that
    is started again with the same folder goes on where it stopped. Without a name it is a new
    folder below the shared one, for feeds that are drained once."""
    query: StreamingQuery = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or fresh_path(stream.sparkSession, f"{label}-checkpoint"))
        .trigger(availableNow=True).foreachBatch(each_batch).start()
    )
    query.awaitTermination()


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Write each batch to its own folder. A batch that is run again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def upsert_batches(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """Keep only the last row per key of each batch (earlier ones are conflated) and store it as
    that batch's part of the table. Readers merge the parts with :func:`read_latest`."""
    from gaugeline.operators.matching import last_per_key

    def write(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c not in (*keys, *order)]
        last_per_key(batch, keys, order, rest).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def read_latest(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """Current state: the last row per key over all parts."""
    from gaugeline.operators.matching import last_per_key

    parts = spark.read.parquet(path)
    rest = [c for c in parts.columns if c not in (*keys, *order, "epoch")]
    return last_per_key(parts, keys, order, rest)


def last_epoch(spark: SparkSession, path: str) -> DataFrame:
    """Result of a stream in complete mode: its newest batch."""
    parts = spark.read.parquet(path)
    newest = F.broadcast(parts.agg(F.max("epoch").alias("epoch")))  # one row
    return parts.join(newest, "epoch", "left_semi").drop("epoch")


def windowed_counts(stream: DataFrame, at: str, keys: list[str], width: str, delay: str, measures: list[Column]) -> DataFrame:
    """Tumbling windows on event time; rows later than ``delay`` are dropped by the watermark."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), *keys).agg(*measures)


def sessions(stream: DataFrame, at: str, keys: list[str], gap: str, delay: str, measures: list[Column]) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(*measures)


class Tiers:
    """A table of parts that stays small: parts of ``fan`` batches become one part of the next tier.

    A part is a folder ``first-last`` of batch numbers. A part inside a longer one is dead, whether its
    removal came through or not, and a batch that is run again after its part was merged is
    skipped; so every step may be interrupted and repeated. ``reduce`` turns several parts into one."""

    def __init__(self, spark: SparkSession, path: str, schema: str, reduce: Callable[[DataFrame], DataFrame], fan: int = 8) -> None:
        self.spark, self.path, self.schema, self.reduce, self.fan = spark, path, schema, reduce, fan

    def _folder(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def parts(self) -> list[tuple[int, int]]:
        """Live parts in order; the listing is one name per part."""
        fs, root = self._folder(self.path)
        if not fs.exists(root):
            return []
        done = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            first, _, last = name.partition("-")
            if first.isdigit() and last.isdigit() and fs.exists(self._folder(f"{self.path}/{name}/_SUCCESS")[1]):
                done.append((int(first), int(last)))
        return sorted(p for p in done if not any(q != p and q[0] <= p[0] and p[1] <= q[1] for q in done))

    def read(self, parts: list[tuple[int, int]] | None = None) -> DataFrame:
        parts = self.parts() if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{a}-{b}" for a, b in parts])

    def add(self, batch: DataFrame, number: int) -> None:
        if any(a <= number <= b and a < b for a, b in self.parts()):
            return  # merged before the batch was reported as done
        batch.write.mode("overwrite").parquet(f"{self.path}/{number}-{number}")
        self.merge()

    def merge(self) -> None:
        size = 1
        while True:
            live = self.parts()
            tier = [p for p in live if size <= p[1] - p[0] + 1 < size * self.fan]
            if len(tier) < self.fan:
                if not any(p[1] - p[0] + 1 >= size * self.fan for p in live):
                    return
                size *= self.fan
                continue
            group = tier[: self.fan]
            self.reduce(self.read(group)).write.mode("overwrite").parquet(f"{self.path}/{group[0][0]}-{group[-1][1]}")
            for a, b in group:
                fs, target = self._folder(f"{self.path}/{a}-{b}")
                fs.delete(target, True)


def delivered_batches(
    tiers: Tiers, outbox: str, keys: list[str], schema: str, accepts: Callable[[DataFrame, int], DataFrame], shrink: Callable[[DataFrame], DataFrame],
) -> Callable[[DataFrame, int], None]:
    """Deliver the rows of each batch per entity; the stored state advances only where delivery succeeds.

    ``accepts(entities, number)`` gives the entities that took their rows. Those of the others go to the
    outbox of the next batch, shrunk with what is new then, and are sent again before it. A batch that
    is run again reads the same outbox and replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, waiting = tiers._folder(f"{outbox}/{number}")
        if fs.exists(waiting):
            batch = batch.unionByName(spark.read.schema(schema).parquet(f"{outbox}/{number}"))
        path = f"{outbox}/sent-{number}"
        shrink(batch).write.mode("overwrite").parquet(path)
        pending = spark.read.schema(schema).parquet(path)
        taken = accepts(pending.select(*keys).distinct(), number)
        pending.join(taken, keys, "left_anti").write.mode("overwrite").parquet(f"{outbox}/{number + 1}")
        tiers.add(pending.join(taken, keys, "left_semi"), number)

    return write
