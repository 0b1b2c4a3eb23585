import pytest
from pyspark.sql import functions as F

from gaugeline.session import fresh_path
from gaugeline.sources import sinks as K
from gaugeline.sources import snapshots as J
from gaugeline.streaming import feeds as D
from gaugeline.streaming import machines as G

GOOD = (
    '{"tick":0,"t_source":1.5,"run":{"run_id":"r1","collector_version":"v0"},"things":{"link-a":{"attributes":{"type":"link"},"features":'
    '{"traffic":{"txRate":2.5,"rateValid":1,"qdiscValid":false,"lossPct":7.0,"q":{"x":1},"rxBytes":null},"status":{"properties":{"state":"odd"}}}}}}'
)


def write(spark, lines):
    path = fresh_path(spark, "t")
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    return path


def test_long_table_keeps_null_apart_from_zero(spark):
    long = {r.prop: r for r in J.sanitize(J.flatten(J.read_snapshots(spark, write(spark, [GOOD])))).collect()}
    assert set(long) == {"txRate", "rateValid", "qdiscValid", "lossPct", "rxBytes", "state"}
    assert long["txRate"].num == 2.5 and long["lossPct"].num is None and long["rxBytes"].num is None
    assert long["state"].txt == "unknown" and long["state"].up is None
    assert {p: r.violation for p, r in long.items() if r.violation} == {"rateValid": "flag", "lossPct": "stray_loss", "state": "state"}


def test_strict_scan_stops_on_a_broken_line(spark):
    path = write(spark, [GOOD, '{"tick": 1, "things'])
    with pytest.raises(Exception, match="not a snapshot"):
        J.read_snapshots(spark, path).collect()
    assert J.read_snapshots(spark, path, strict=False).count() == 1


def test_contract_problems(spark):
    want = spark.createDataFrame([("link-a",), ("link-b",)], "e string")
    r = J.contract_problems(J.read_snapshots(spark, write(spark, [GOOD])), want, "e", "v9").first()
    assert (r.missing, r.extra, r.problems) == ("link-b", "", "missing,version")


def test_csv_keeps_missing_cells_and_write_once_refuses(spark):
    path = fresh_path(spark, "csv")
    K.export_csv(spark.createDataFrame([(1, None), (2, 0.0)], "a int, b double"), path)
    assert sorted(map(tuple, spark.read.option("header", True).schema("a int, b double").csv(path).collect())) == [(1, None), (2, 0.0)]
    with pytest.raises(Exception):
        K.write_once(spark.range(1), path)


def test_stream_rejects_late_rows_and_keeps_the_state(spark):
    path, out = fresh_path(spark, "feed"), fresh_path(spark, "out")
    schema = "run string, tick long, status string, suspect boolean, act boolean"
    for batch in ([("r", 0, "warming_up", False, False), ("r", 1, "scored", True, False)], [("r", 1, "scored", False, False), ("r", 2, "scored", False, False)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", D.ROCKSDB)
    feed = D.file_feed(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    full = schema + ", state string, prev string, rejected boolean"
    names = [c.split()[0] for c in full.split(", ")]
    D.run_available(G.fold(feed, ["run"], G.alarm_step(), "tick", full, names), D.append_batches(out))
    got = spark.read.schema(full).parquet(f"{out}/epoch=*").orderBy("tick", "rejected").collect()
    assert [(r.tick, r.state, r.rejected) for r in got] == [(0, "warming_up", False), (1, "suspect", False), (1, None, True), (2, "suspect", False)]


def test_upsert_parts_are_idempotent(spark):
    path = fresh_path(spark, "upsert")
    write_batch = D.upsert_batches(path, ["k"], ["t"])
    first = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 3.0), ("b", 1, 9.0)], "k string, t long, v double")
    for _ in range(2):
        write_batch(first, 0)
    write_batch(spark.createDataFrame([("a", 2, 2.0), ("b", 5, 5.0)], "k string, t long, v double"), 1)
    assert sorted(map(tuple, D.read_latest(spark, path, ["k"], ["t"]).collect())) == [("a", 3, 3.0), ("b", 5, 5.0)]
    assert spark.read.parquet(path).where(F.col("epoch") == 0).count() == 2
