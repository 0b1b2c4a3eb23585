"""State that ends by event time: what is emitted, and what is left of the state."""

import itertools

import pytest
from pyspark.sql import functions as F

from gaugeline.plans.streams import drained, watched
from gaugeline.session import fresh_path
from gaugeline.streaming import feeds as D
from gaugeline.streaming import timers as T

HOUR = 3600 * 10**6
START = 1000 * HOUR  # event times at 0 would be behind the first watermark


def feed(spark, slices, schema):
    """Each slice is one file and one batch."""
    path = fresh_path(spark, "slices")
    at = schema.replace(" bigint", "").replace(" string", "").split(", ").index("us")
    slices = [[(*r[:at], r[at] + START, *r[at + 1 :]) for r in rows] for rows in slices]
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return D.file_feed(spark, path, spark.createDataFrame([], schema).schema, files_per_trigger=1)


def kept(spark, checkpoint):
    return spark.read.format("statestore").option("stateVarName", "kept").load(checkpoint)


def test_leases_end_with_and_without_a_renewal(spark):
    slices = [[("a", 0), ("b", 0), ("c", HOUR)], [("a", 2 * HOUR), ("b", 9 * HOUR), ("b", 9 * HOUR)], [("d", 30 * HOUR), ("a", 29 * HOUR)]]
    rows = feed(spark, slices, "key string, us bigint")
    checkpoint, schema = fresh_path(spark, "checkpoint"), "key string, expired_at bigint"
    out = drained(spark, T.ending(watched(rows, "1 hour"), T.Leases(["key"], 3 * HOUR), schema), schema, "leases", checkpoint)
    got = sorted((r.key, (r.expired_at - START) // HOUR) for r in out.collect())
    # a ran out between 2 and 29, b between 0 and 9 and then at 12, c was never renewed; a and d still hold at 29
    assert got == [("a", 5), ("b", 3), ("b", 12), ("c", 4)]
    assert {r.key.key for r in kept(spark, checkpoint).collect()} == {"a", "d"}


def test_rows_behind_the_last_renewal_count_for_nothing(spark):
    rows = feed(spark, [[("a", 10 * HOUR)], [("a", 10 * HOUR), ("a", 9 * HOUR + 1)], [("z", 20 * HOUR)]], "key string, us bigint")
    schema = "key string, expired_at bigint"
    out = drained(spark, T.ending(watched(rows, "2 hours"), T.Leases(["key"], 3 * HOUR), schema), schema, "leases")
    assert [(r.key, r.expired_at - START) for r in out.collect()] == [("a", 13 * HOUR)]


@pytest.mark.parametrize("cut", [1, 3])
def test_first_deliveries_do_not_depend_on_the_batches(spark, cut):
    times = [0, 1, 2, 3, 4, 7, 8, 11, 12, 20]
    slices = [[("m", t * HOUR) for t in part] for part in itertools.batched(times, cut)] + [[("other", 60 * HOUR)]]
    checkpoint, schema = fresh_path(spark, "checkpoint"), "key string, us bigint"
    out = drained(spark, T.ending(watched(feed(spark, slices, schema), "1 hour"), T.FirstDeliveries(["key"], 3 * HOUR), schema), schema, "first", checkpoint)
    assert sorted((r.us - START) // HOUR for r in out.where("key = 'm'").collect()) == [0, 3, 7, 11, 20]
    assert {r.key.key for r in kept(spark, checkpoint).collect()} == {"other"}


def test_silence_ends_what_is_known_of_a_device(spark):
    rows = [[("d", 0, 0, "b0", 1), ("d", 1, HOUR, "b1", 1)], [("d", 2, 2 * HOUR, "b0", 9)], [("d", 3, 40 * HOUR, "b0", 2), ("d", 4, 41 * HOUR, "b0", 2)]]
    checkpoint, schema = fresh_path(spark, "checkpoint"), "key string, tick bigint, accepted boolean, confirmed_at bigint"
    stream = watched(feed(spark, rows, "key string, tick bigint, us bigint, boot string, seq bigint"), "1 hour")
    out = drained(spark, T.ending(stream, T.Freshness(["key"], 10 * HOUR), schema), schema, "fresh", checkpoint)
    got = [(r.tick, r.accepted, r.confirmed_at and r.confirmed_at - START) for r in out.orderBy("tick").collect()]
    # b0 was left for b1, but after the silence it is a first message again
    assert got == [(0, True, None), (1, True, HOUR), (2, False, HOUR), (3, True, None), (4, False, None)]
    assert kept(spark, checkpoint).select(F.col("value.retired")).first()[0] == []


@pytest.mark.parametrize("bundles", [1, 3])
def test_bundled_keys_emit_what_single_keys_emit(spark, bundles):
    slices = [[("a", 0), ("b", 0), ("c", HOUR)], [("a", 2 * HOUR), ("b", 9 * HOUR), ("b", 9 * HOUR), (None, 9 * HOUR)], [("d", 30 * HOUR), ("a", 29 * HOUR)]]
    checkpoint, leases = fresh_path(spark, "checkpoint"), "key string, expired_at bigint"
    rows = feed(spark, slices, "key string, us bigint")
    out = drained(spark, T.ending(watched(rows, "1 hour"), T.Leases(["key"], 3 * HOUR), leases, bundles), leases, "leases", checkpoint)
    got = sorted((r.key or "", (r.expired_at - START) // HOUR) for r in out.collect())
    assert got == [("", 12), ("a", 5), ("b", 3), ("b", 12), ("c", 4)]
    assert {r.list_element.key for r in kept(spark, checkpoint).collect()} == {"a", "d"}  # ended states are gone
    first = "key string, us bigint"
    rows = feed(spark, [[("m", t * HOUR) for t in part] for part in itertools.batched([0, 1, 2, 3, 4, 7, 8, 11, 12, 20], 3)] + [[("other", 60 * HOUR)]], first)
    out = drained(spark, T.ending(watched(rows, "1 hour"), T.FirstDeliveries(["key"], 3 * HOUR), first, bundles), first, "first")
    assert sorted((r.us - START) // HOUR for r in out.where("key = 'm'").collect()) == [0, 3, 7, 11, 20]
