"""Text sources: command-flow logs, counter listings, queue listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Log markers and their stages, tested in this order.
STAGES = (
    ("CLICK", "click"), ("DITTO_RESPONSE", "ditto_response"), ("UI_ACK", "ui_ack"), ("WAIT_STATE", "wait"), ("RECEIVE", "agent_receive"),
    ("LOCK_WAIT", "lock_wait"), ("EXECUTE_DONE", "exec_done"), ("STATE_DETECTED", "detect"), ("STATE_PUSHED", "push"),
    ("STATE_OK_AFTER_RESYNC", "ui_resync"), ("STATE_TIMEOUT", "ui_timeout"), ("STATE_OK", "ui"),
)
DOWN_MARKERS = (
    "failed to connect", "broken pipe", "connection refused", "no such bridge", "is not a bridge", "does not exist", "version negotiation failed",
)
QDISC = "array<struct<kind:string, handle:string, parent:string, drops:bigint, packets:bigint>>"


def stage_of(line: Column) -> Column:
    out = F.when(line.contains(STAGES[0][0]), STAGES[0][1])
    for marker, stage in STAGES[1:]:
        out = out.when(line.contains(marker), stage)
    return out


def field(line: Column, key: str) -> Column:
    """Value of ``key=value``; NULL when the key is absent."""
    return F.nullif(F.regexp_extract(line, rf"(?:^|[^\w-]){key}=([^\s\]]*)", 1), F.lit(""))


def expected_state(subject: Column) -> Column:
    return F.when(subject.isin("disableLink", "disableHost"), "down").when(subject.isin("enableLink", "enableHost"), "up")


def parse_flow_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Known stages with a readable time; detect and push lines need a target. Time is in
    microseconds of the clock the log was written with."""
    line = F.col(column)
    stamp = F.try_to_timestamp(F.nullif(F.regexp_extract(line, r"^\[([\d-]+ [\d:.]+)\]", 1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    rows = lines.select(
        F.unix_micros(stamp).alias("us"), stage_of(line).alias("stage"), F.coalesce(field(line, "target"), F.lit("-")).alias("target"),
        field(line, "cid").alias("cid"), field(line, "subject").alias("subject"), field(line, "detail").alias("detail"),
        field(line, "waitMs").try_cast("double").alias("wait_ms"),
    )
    return rows.where("us is not null and stage is not null and not (stage in ('detect', 'push') and target = '-')").withColumn(
        "expect", expected_state(F.col("subject"))
    )


def read_flow_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_flow_log(spark.read.text(path))


def interface_counters(text: Column, iface: str) -> Column:
    """Counters of one interface from a /proc/net/dev listing; NULL when it is not readable."""
    row = F.regexp_extract(text, rf"(?m)^\s*{iface}:\s*(.*)$", 1)
    cols = F.split(F.trim(row), r"\s+")
    at = lambda i: F.try_element_at(cols, F.lit(i + 1)).try_cast("bigint")
    parts = F.struct(at(0).alias("rx_bytes"), at(1).alias("rx_packets"), at(3).alias("rx_drop"), at(8).alias("tx_bytes"), at(9).alias("tx_packets"), at(11).alias("tx_drop"))
    whole = (F.size(cols) > 11) & at(0).isNotNull() & at(1).isNotNull() & at(3).isNotNull() & at(8).isNotNull() & at(9).isNotNull() & at(11).isNotNull()
    return F.when(whole, parts)


def ping_figures(text: Column) -> tuple[Column, Column]:
    """(average latency in ms, loss percent), each NULL when its line is missing."""
    latency = F.regexp_extract(text, r"min/avg/max[^=]*=\s*[\d.]+/([\d.]+)", 1).try_cast("double")
    loss = F.regexp_extract(text, r"([\d.]+)% packet loss", 1).try_cast("double")
    return latency, loss


def switch_state(text: Column) -> Column:
    """An error text is no sign of life: empty is unknown, connection errors are down."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    down = F.lit(False)
    for marker in DOWN_MARKERS:
        down = down | low.contains(marker)
    return F.when(low == "", "unknown").when(down, "down").when(low.contains("port"), "up").otherwise("unknown")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def leaf_queues(text: Column) -> Column:
    """Sums over queues whose handle is no parent prefix; NULL on any defect. The text is parsed once."""
    return _once(F.from_json(text, QDISC), lambda rows: _once(_parents(rows), lambda parents: _once(
        F.filter(rows, lambda r: ~F.array_contains(parents, r["handle"])), _leaf_sums)))


def _parents(rows: Column) -> Column:
    return F.transform(F.filter(rows, lambda r: r["parent"].isNotNull()), lambda r: F.concat(F.split_part(r["parent"], F.lit(":"), F.lit(1)), F.lit(":")))


def _leaf_sums(leaves: Column) -> Column:
    broken = F.exists(leaves, lambda r: r["drops"].isNull() | r["packets"].isNull() | r["kind"].isNull() | r["handle"].isNull())
    add = lambda name: F.aggregate(leaves, F.lit(0).cast("bigint"), lambda acc, r: acc + r[name])
    signature = F.array_join(F.array_sort(F.transform(leaves, lambda r: F.concat_ws("/", r["kind"], r["handle"], F.coalesce(r["parent"], F.lit("root"))))), ";")
    return F.when((F.size(leaves) > 0) & ~broken, F.struct(add("drops").alias("drops"), add("packets").alias("packets"), signature.alias("signature")))
