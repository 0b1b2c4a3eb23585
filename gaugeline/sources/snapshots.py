"""Nested snapshot files: one JSON line per run and tick, read into one long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the snapshot contract.
BOOL_FLAGS = ("rateValid", "qdiscValid")
NUMERIC_PROPS = ("rxRate", "txRate", "lossPct", "bwMbps", "rxBytes", "txBytes")
STATES = ("up", "down", "unknown")
POINTER_MAGIC = "version https://git-lfs"

SCHEMA = (
    "timestamp string, t_source double, tick bigint, t_rel double, run struct<run_id:string, collector_version:string>, "
    "things map<string, struct<attributes:map<string,string>, features:map<string,map<string,variant>>, t_source:double>>, "
    "_corrupt_record string"
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with their file name and a class: ok, blank, pointer or broken."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("source_file"))
    parsed = raw.withColumn("_j", F.from_json("value", SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    kind = (
        F.when(F.trim("value") == "", "blank").when(F.col("value").startswith(POINTER_MAGIC), "pointer")
        .when(F.col("_j._corrupt_record").isNotNull() | F.col("_j.things").isNull(), "broken").otherwise("ok")
    )
    return parsed.withColumn("line_kind", kind)


def read_snapshots(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Parsed snapshots. In strict mode any other line fails the job; nothing is skipped."""
    lines = read_lines(spark, path)
    if strict:
        message = F.concat(F.lit("line is not a snapshot: "), F.col("line_kind"), F.lit(" in "), F.col("source_file"))
        lines = lines.where(F.coalesce(F.assert_true(F.col("line_kind") == "ok", message).isNull(), F.lit(True)))
    else:
        lines = lines.where("line_kind = 'ok'")
    return lines.select("source_file", "_j.*").drop("_corrupt_record")


def _props(feature: Column) -> Column:
    """Properties of a feature, with the optional ``properties`` wrapper taken off."""
    inner = F.try_variant_get(feature["properties"], "$", "map<string,variant>")
    return F.coalesce(inner, feature)


def flatten(snapshots: DataFrame) -> DataFrame:
    """Long table (run, tick, entity, feature, prop): number, flag or text, with the value's type.
    Nested values stay out, a lossPct beside a false qdiscValid is NULL, and ``up`` holds the
    state as 1, 0 or NULL without touching the text."""
    entities = snapshots.select(
        F.col("run.run_id").alias("run_id"), F.col("run.collector_version").alias("collector_version"), "tick", "t_source",
        F.explode("things").alias("entity", "_t"),
    )
    features = entities.select("*", F.col("_t.attributes").alias("attributes"), F.explode("_t.features").alias("feature", "_f"))
    props = features.withColumn("_f", _props(F.col("_f")))
    qdisc = F.try_variant_get(F.col("_f")["qdiscValid"], "$", "boolean")
    rows = props.withColumn("qdisc_valid", F.when(F.schema_of_variant(F.col("_f")["qdiscValid"]) == "BOOLEAN", qdisc))
    rows = rows.select("run_id", "collector_version", "tick", "t_source", "entity", "feature", "qdisc_valid", F.explode("_f").alias("prop", "_v"))
    kind = F.regexp_extract(F.schema_of_variant("_v"), "^[A-Z]+", 0)
    rows = rows.withColumn("value_type", kind).where(~F.col("value_type").isin("OBJECT", "ARRAY"))
    number = F.when(F.col("value_type").isin("DECIMAL", "BIGINT", "DOUBLE", "FLOAT"), F.try_variant_get("_v", "$", "double"))
    masked = (F.col("prop") == "lossPct") & ~F.coalesce("qdisc_valid", F.lit(True))
    text = F.when(F.col("value_type") == "STRING", F.try_variant_get("_v", "$", "string"))
    return rows.select(
        "run_id", "collector_version", "tick", "t_source", "entity", "feature", "prop", "value_type", "qdisc_valid",
        F.when(~masked, number).alias("num"), number.alias("raw_num"),
        F.when(F.col("value_type") == "BOOLEAN", F.try_variant_get("_v", "$", "boolean")).alias("flag"), text.alias("txt"),
        F.when(F.col("prop") == "state", F.when(text == "up", 1).when(text == "down", 0)).alias("up"),
    )


def sanitize(long: DataFrame) -> DataFrame:
    """Repair values against the contract and name each repair in ``violation``."""
    bad_flag = F.col("prop").isin(*BOOL_FLAGS) & (F.col("value_type") != "BOOLEAN")
    bad_number = F.col("prop").isin(*NUMERIC_PROPS) & (F.col("value_type") != "VOID") & (
        F.col("raw_num").isNull() | F.isnan("raw_num") | (F.abs("raw_num") == float("inf"))
    )
    bad_state = (F.col("prop") == "state") & ~F.coalesce(F.col("txt").isin(*STATES), F.lit(False))
    stray_loss = (F.col("prop") == "lossPct") & ~F.coalesce("qdisc_valid", F.lit(True)) & F.col("raw_num").isNotNull()
    return long.withColumns({
        "violation": F.when(bad_flag, "flag").when(bad_number, "number").when(bad_state, "state").when(stray_loss, "stray_loss"),
        "flag": F.when(bad_flag, False).otherwise(F.col("flag")), "num": F.when(bad_number | stray_loss, F.lit(None)).otherwise(F.col("num")),
        "txt": F.when(bad_state, "unknown").otherwise(F.col("txt")),
    })


def contract_problems(snapshots: DataFrame, expected: DataFrame, column: str, version: str) -> DataFrame:
    """Missing and extra entities, version and tick problems per snapshot. ``expected`` lists the
    model's entities and is collected into one array, which is as long as the model is wide."""
    wanted = F.broadcast(expected.agg(F.array_sort(F.collect_set(column)).alias("_want")))
    have = F.array_sort(F.map_keys("things"))
    joined = snapshots.join(wanted).select(
        F.col("run.run_id").alias("run_id"), "tick", F.array_except("_want", have).alias("missing"), F.array_except(have, F.col("_want")).alias("extra"),
        F.col("run.collector_version").alias("_v"), "t_source",
    )
    notes = F.array(
        F.when(F.col("t_source").isNull() | F.isnan("t_source"), "t_source"), F.when(F.size("missing") > 0, "missing"),
        F.when(F.size("extra") > 0, "extra"), F.when(~F.col("_v").eqNullSafe(version), "version"), F.when(F.col("tick").isNull(), "tick"),
    )
    return joined.select(
        "run_id", "tick", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"),
        F.array_join(F.filter(notes, lambda x: x.isNotNull()), ",").alias("problems"),
    )


def to_updates(snapshots: DataFrame) -> DataFrame:
    """One update per entity: kind from the attributes or the key prefix, canonical id for links,
    NULL properties dropped, and lossPct kept as an explicit deletion beside a false flag."""
    rows = snapshots.select(F.col("run.run_id").alias("run_id"), "tick", F.explode("things").alias("entity", "t"))
    prefix = F.split_part("entity", F.lit("-"), F.lit(1))
    kind = F.coalesce(F.col("t.attributes")["type"], F.when(prefix.isin("host", "switch", "link", "path"), prefix))
    body = F.regexp_replace("entity", "^(host|switch|link|path)-", "")
    left, right = F.split_part(body, F.lit("-"), F.lit(1)), F.regexp_replace(body, "^[^-]*-?", "")
    other = F.when(right == "", left).otherwise(right)
    thing = F.when(kind == "link", F.concat(F.lit("link-"), F.least(left, other), F.lit("-"), F.greatest(left, other))).otherwise(F.col("entity"))
    traffic = _props(F.col("t.features")["traffic"])
    kept = F.map_filter(traffic, lambda k, v: F.schema_of_variant(v) != "VOID")
    deleted = F.coalesce(F.try_variant_get(traffic["qdiscValid"], "$", "boolean") == F.lit(False), F.lit(False))
    names = F.array_sort(F.map_keys(F.map_filter(kept, lambda k, v: ~((k == "lossPct") & deleted))))
    return rows.where(kind.isNotNull()).select(
        "run_id", "tick", thing.alias("thing"), kind.alias("kind"), F.array_join(names, ",").alias("props"), deleted.alias("deletes_loss"),
        F.try_variant_get(traffic["txRate"], "$", "double").alias("tx_rate"), F.try_variant_get(_props(F.col("t.features")["status"])["state"], "$", "string").alias("state"),
    )
