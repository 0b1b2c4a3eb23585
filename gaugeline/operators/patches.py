"""Merge patches on nested documents as a log of leaf paths.

A patch is a JSON object: members replace or extend those of the document, object members merge at every
depth, and a NULL deletes the member with all below it. As rows, a patch is its leaves: a path with a
value, or with NULL for a deletion. Of all leaves ever written, one is still there if nothing was written
later at its own path, above it (a value or a deletion replaced the whole branch) or below it (the value
became an object). That needs the last write of each path and two maxima, not the documents.

A log may be compacted at any time: what is left gives the same document whatever comes later or was
written before it, so parts of a log can be compacted apart and together. Deletions stay in it for
older parts; :func:`document` drops them. An object without members is not told apart from none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.session import cut_lineage

SEPARATOR = "\u0001"


def leaves(patches: DataFrame, keys: list[str], order: list[str], patch: str, depth: int = 16) -> DataFrame:
    """(keys, order, path, value): the leaves of JSON patches; ``path`` is an array of member names and
    ``value`` JSON text, NULL for a deletion. A patch that is not an object has none; levels below
    ``depth`` are an error."""
    rest = [*keys, *order]
    level = patches.select(*rest, F.array().cast("array<string>").alias("path"), F.try_parse_json(patch).alias("_v"))
    level = level.where(F.col("_v").isNotNull() & F.schema_of_variant("_v").startswith("OBJECT"))
    found = []
    for _ in range(depth):
        members = level.lateralJoin(patches.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        kind = F.schema_of_variant("value")
        nested = kind.startswith("OBJECT") & (kind != "OBJECT<>")
        value = F.when(~F.is_variant_null("value"), F.to_json("value"))
        # written once, so that a level does not repeat the ones above it
        told = cut_lineage(members.select(*rest, F.concat("path", F.array("key")).alias("path"), F.when(~nested, value).alias("value"), F.to_json("value").alias("_j"), nested.alias("_nested")))
        found.append(told.where("not _nested").select(*rest, "path", "value"))
        level = told.where("_nested").select(*rest, "path", F.parse_json("_j").alias("_v"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
    raise ValueError(f"a patch has more than {depth} levels")


def compact(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of a log of leaves (keys, order, path, value) that still matter, deletions included."""
    at = F.struct(*order)
    name = F.array_join("path", SEPARATOR)
    last = log.withColumn("_p", name).groupBy(*keys, "_p").agg(F.max_by(F.struct("path", "value", *order), at).alias("_w")).select(*keys, "_p", "_w.*")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.array_join(F.slice("path", F.lit(1), n), SEPARATOR))
    above = F.when(F.size("path") > 1, prefixes).otherwise(F.array().cast("array<string>"))
    # each path with the last write below it
    marks = last.select(*keys, F.explode(above).alias("_p"), at.alias("_at")).groupBy(*keys, "_p").agg(F.max("_at").alias("_below"))
    # a value that became an object is gone, but what it replaced stays replaced: it goes on as a deletion
    stays = F.col("_below").isNull() | (at > F.col("_below"))
    open_ = last.join(marks, [*keys, "_p"], "left").withColumn("value", F.when(stays, F.col("value")))
    # and the last write above it
    asked = last.select(*keys, "_p", F.explode(above).alias("_q"))
    over = asked.join(last.select(*keys, F.col("_p").alias("_q"), at.alias("_at")), [*keys, "_q"]).groupBy(*keys, "_p").agg(F.max("_at").alias("_above"))
    kept = open_.join(over, [*keys, "_p"], "left").where(F.col("_above").isNull() | (at > F.col("_above")))
    return kept.select(*keys, *order, "path", "value")


def document(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, order, path, value): the leaves of the present documents."""
    return compact(log, keys, order).where("value is not null")
