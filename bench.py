"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

HEADLINE = (
    "run_alarm_summary", "envelope_scores", "heldout_calibration", "rolling_past_mean", "counter_rates", "queue_interval_loss", "alarm_states",
    "channel_machines", "ordered_ingest", "merged_intervals", "act_attribution", "feature_audit", "missing_by_profile", "percentile_rules",
    "flow_outcomes", "snapshot_long_table", "command_latency", "cluster_bootstrap", "stream_latest_state",
)


def main() -> None:
    from gaugeline import session
    from gaugeline.plans import load_all
    from gaugeline.plans.registry import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = session.build(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()  # warm up
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    # a fixed piece of work that no code here can change, to tell a slower machine from slower queries
    for _ in range(2):
        fixed = spark.range(0, 40_000_000, 1, 64).selectExpr("id % 1000003 AS k", "sqrt(id) AS v").groupBy("k").agg({"v": "sum"})
        start = time.perf_counter()
        fixed.write.format("noop").mode("overwrite").save()
        calibration = round(time.perf_counter() - start, 3)
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        with contextlib.redirect_stdout(sys.stderr):
            QUERIES[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf.rstrip("/").split("sf")[-1], "cpus": int(cpus), "events": events, "calibration_sec": calibration}))
    spark.stop()


if __name__ == "__main__":
    main()
