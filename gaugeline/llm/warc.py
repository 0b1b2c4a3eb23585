"""WARC records and a Merkle audit of their replicas.

``records_of`` writes pages as WARC/1.0 resource records, grouped into files by page id. A catalogue holds
what one side has: record id, own offset, length and SHA-256 of each record; only this travels, the
payload is hashed where it is read. ``audit`` hashes each side's records, with their offsets, into its own
tree: a leaf is the records that start in one range of bytes, in the order of their offsets, and nodes
have a fan-out of 16. Roots are compared and only ranges whose digests differ are opened, so equal
files cost one comparison. Records of open ranges, and no others, are then aligned by record id.

Verdicts: ``missing``; ``extra``, or ``duplicate`` where the primary has the record fewer times; ``changed``
bytes; ``moved``, if its place among the records that both sides have differs; and ``shifted``, if only its
offset does. Shifted records that follow each other by one distance are one row with their number.

Defined results: null url or html is empty; a null page_id puts a record into a file by its hash;
equal records are told apart by their copy number in offset order; equal or empty replicas give no rows. A
file is laid out and numbered in one task, so it has at most about ``per_file`` records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.session import cut_lineage

FAN = 16
LEVELS = 3  # FAN ** LEVELS ranges are under one root; a file with more has several roots
RANGE_BYTES = 64 << 10
RECORDS_PER_FILE = 4096
END = "\r\n"


def records_of(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """(file, record_id, page_id, record) of each page."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    digest = F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, html))
    identity = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    number = F.coalesce(F.floor(F.col("page_id") / per_file), F.pmod(F.xxhash64(digest), F.lit(1 << 20)) + (1 << 40))
    head = F.concat(
        F.lit(f"WARC/1.0{END}WARC-Type: resource{END}WARC-Record-ID: <urn:uuid:"), F.col("record_id"), F.lit(f">{END}WARC-Date: 2024-01-01T00:00:00Z{END}WARC-Target-URI: "), url,
        F.lit(f"{END}Content-Type: text/html{END}Content-Length: "), F.octet_length(html).cast("string"), F.lit(END + END),
    )
    out = pages.select(F.format_string("pages-%013d.warc", number.cast("bigint")).alias("file"), identity.alias("record_id"), "page_id", "url", "html")
    return out.select("file", "record_id", "page_id", F.concat(head, html, F.lit(END + END)).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """One folder per file below ``path`` with the records in page order, written by Spark."""
    lines = records.select("file", "page_id", F.expr("left(record, length(record) - 2)").alias("value"))
    ordered = lines.repartition("file").sortWithinPartitions("file", "page_id", "value").select("file", "value")
    ordered.write.partitionBy("file").option("lineSep", END).text(path)


def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of WARC bytes by their Content-Length."""
    for batch in batches:
        for file, data in zip(batch["file"], batch["content"], strict=True):
            rows, at = [], 0
            while at < len(data):
                body = data.index(b"\r\n\r\n", at) + 4
                head = dict(line.split(b": ", 1) for line in data[at:body].split(b"\r\n")[1:] if b": " in line)
                end = body + int(head[b"Content-Length"]) + 4
                rows.append((file, head[b"WARC-Record-ID"].decode()[10:-1], at, data[at:end].decode("utf-8", "replace")))
                at = end
            yield pd.DataFrame(rows, columns=["file", "record_id", "offset", "record"])


def read_warc(spark, path: str) -> DataFrame:
    """(file, record_id, offset, record) of what :func:`write_warc` wrote; one task holds one part file."""
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("file", "content")
    return content.mapInPandas(parse, "file string, record_id string, offset bigint, record string")


def laid_out(records: DataFrame, order: list[str]) -> DataFrame:
    """``records`` with ``offset``, as if each file had been written in ``order``."""
    in_file = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum(F.octet_length("record").cast("bigint")).over(in_file), F.lit(0)))


def catalogue(records: DataFrame) -> DataFrame:
    """(file, record_id, copy, page_id, offset, slot, length, digest), without payload; ``slot`` numbers the
    records of a file by their own offsets. Records without ``offset`` are laid out in page order."""
    records = records if "offset" in records.columns else laid_out(records, ["page_id", "record_id"])
    page = F.col("page_id") if "page_id" in records.columns else F.lit(None).cast("bigint").alias("page_id")
    thin = records.select("file", "record_id", page, "offset", F.octet_length("record").cast("bigint").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("offset")).cast("bigint")
    return thin.withColumns({"slot": place("file") - 1, "copy": place("file", "record_id")})


def byte_range(offset: Column) -> Column:
    return F.floor(offset / RANGE_BYTES)


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels of (file, node, digest), ranges of bytes first. A range hashes its records by offset, with their
    offsets and lengths; a node hashes the numbers and digests of the children it has."""
    entry = F.struct("offset", "length", "record_id", "digest")
    ranges = records.groupBy("file", byte_range(F.col("offset")).alias("node")).agg(F.sort_array(F.collect_list(entry)).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["offset"], x["length"], x["record_id"], x["digest"])), " ")
    levels = [cut_lineage(ranges.select("file", "node", F.sha2(text, 256).alias("digest")))]
    for _ in range(LEVELS):
        child = F.struct("node", "digest")
        parents = levels[-1].groupBy("file", F.floor(F.col("node") / FAN).alias("node")).agg(F.sort_array(F.collect_list(child)).alias("c"))
        text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"], x["digest"])), " ")
        levels.append(parents.select("file", "node", F.sha2(text, 256).alias("digest")))
    return levels


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.withColumnRenamed("digest", "_a").join(b.withColumnRenamed("digest", "_b"), ["file", "node"], "full")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b")))


def open_ranges(up: list[DataFrame], down: list[DataFrame]) -> DataFrame:
    """(file, node) of the ranges that differ, found from the roots down."""
    found = differing(up[-1], down[-1])
    for a, b in zip(up[-2::-1], down[-2::-1], strict=True):
        parents = found.select("file", F.col("node").alias("_parent"))
        below = lambda x: x.withColumn("_parent", F.floor(F.col("node") / FAN)).join(parents, ["file", "_parent"], "left_semi").drop("_parent")  # noqa: E731, B023
        found = differing(below(a), below(b))
    return found.select("file", "node")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Differences between two catalogues: (file, page_id, offset, length, replica_offset, replica_length,
    digest, replica_digest, verdict, n_records). A row of shifted records gives the first offsets and
    the sum of lengths."""
    ours, theirs = cut_lineage(primary), cut_lineage(replica)
    ranges = cut_lineage(open_ranges(tree(ours), tree(theirs)))
    key = ["file", "record_id", "copy"]
    held = [x.withColumn("node", byte_range(F.col("offset"))).join(ranges, ["file", "node"], "left_semi") for x in (ours, theirs)]
    names = ("page_id", "offset", "slot", "length", "digest")
    a = held[0].select(*key, *[F.col(c).alias(f"a_{c}") for c in names])
    b = held[1].select(*key, *[F.col(c).alias(f"b_{c}") for c in names])
    both = cut_lineage(a.join(b, key, "full"))
    # place among the records of both sides: the own number less the records before that only this side has
    before = lambda own, other: F.col(f"{own}_slot") - F.coalesce(F.sum(F.col(f"{other}_offset").isNull().cast("bigint")).over(
        Window.partitionBy("file", F.col(f"{own}_offset").isNull()).orderBy(f"{own}_offset").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = both.withColumns({"a_place": before("a", "b"), "b_place": before("b", "a")})
    known = told.join(ours.select("file", "record_id").distinct().withColumn("_known", F.lit(True)), ["file", "record_id"], "left")
    verdict = (
        F.when(F.col("b_offset").isNull(), "missing").when(F.col("a_offset").isNull(), F.when(F.col("_known"), "duplicate").otherwise("extra"))
        .when(F.col("a_digest") != F.col("b_digest"), "changed").when(F.col("a_place") != F.col("b_place"), "moved").when(F.col("a_offset") != F.col("b_offset"), "shifted"))
    found = cut_lineage(known.withColumn("verdict", verdict).where("verdict is not null"))
    out = [F.coalesce("a_page_id", "b_page_id").alias("page_id"), F.col("a_offset").alias("offset"), F.col("a_length").alias("length"), F.col("b_offset").alias("replica_offset"),
           F.col("b_length").alias("replica_length"), F.col("a_digest").alias("digest"), F.col("b_digest").alias("replica_digest"), "verdict", F.lit(1).cast("bigint").alias("n_records")]
    single = found.where("verdict <> 'shifted'").select("file", *out)
    distance = (F.col("b_offset") - F.col("a_offset")).alias("by")
    moved = found.where("verdict = 'shifted'").select("file", distance, "a_place", "a_page_id", "a_offset", "b_offset", "a_length", "b_length")
    run = F.col("a_place") - F.row_number().over(Window.partitionBy("file", "by").orderBy("a_place"))
    runs = moved.withColumn("_run", run).groupBy("file", "by", "_run").agg(
        F.min_by("a_page_id", "a_offset").alias("page_id"), F.min("a_offset").alias("offset"), F.sum("a_length").alias("length"), F.min("b_offset").alias("replica_offset"),
        F.sum("b_length").alias("replica_length"), F.count(F.lit(1)).alias("n_records"))
    none = F.lit(None).cast("string")
    return single.unionByName(runs.select("file", "page_id", "offset", "length", "replica_offset", "replica_length", none.alias("digest"), none.alias("replica_digest"), F.lit("shifted").alias("verdict"), "n_records"))


def damaged(records: DataFrame, number: Column) -> DataFrame:
    """A replica with damage chosen by ``number``: one in 61 is lost, one in 53 is cut short, one in 47 has a
    changed byte, one in 97 has changed places with its neighbour, one in 89 is there twice."""
    record = F.when(number % 53 == 1, F.expr("left(record, length(record) - 9)")).when(number % 47 == 2, F.concat(F.expr("left(record, length(record) - 5)"), F.lit("~"), F.expr("right(record, 4)"))).otherwise(F.col("record"))
    kept = records.where(~F.coalesce(number % 61 == 0, F.lit(False))).withColumn("record", record)
    place = F.when(number % 97 == 3, number + 1).when(number % 97 == 4, number - 1).otherwise(number)
    times = F.when(number % 89 == 5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    placed = kept.withColumns({"_place": place, "_time": F.explode(times)})
    return laid_out(placed, ["_place", "record_id", "_time"]).drop("_place", "_time")
