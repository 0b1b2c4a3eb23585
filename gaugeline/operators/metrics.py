"""Evaluation: labels and masks, confusion counts, delays, incidents, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("tp", "fp", "fn", "tn", "n_unknown_positive", "n_unknown_negative")


def in_fault(tick: Column, inject: Column, revert: Column) -> Column:
    """A rate at t describes (t-1, t], so the label is 1 iff inject < t <= revert."""
    return F.coalesce((tick > inject) & (tick <= revert), F.lit(False))


def in_transition(tick: Column, inject: Column, revert: Column, onset: int = 2, recovery: int = 2) -> Column:
    return in_fault(tick, inject, inject + onset) | in_fault(tick, revert, revert + recovery)


def confusion(frame: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts over in_eval rows; an unknown positive is a miss, an unknown negative a pass."""
    rows = frame.where("in_eval")
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    return grouped.agg(*count_columns())


def count_columns() -> list[Column]:
    y, a, j = F.col("y"), F.col("alarm"), F.col("judgeable")
    tests = dict(zip(COUNTS, (y & a, ~y & a, y & ~a, ~y & ~a, y & ~j, ~y & ~j)))
    return [F.count_if(test).alias(name) for name, test in tests.items()]


def scores(counts: DataFrame) -> DataFrame:
    """Ratios from counts, NULL on an empty denominator."""
    p, n = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    judged = n - F.col("n_unknown_negative")
    ratio = lambda top, bottom: F.try_divide(top.cast("double"), bottom.cast("double"))
    return counts.withColumns({
        "recall": ratio(F.col("tp"), p), "recall_ceiling": ratio(p - F.col("n_unknown_positive"), p),
        "fpr": ratio(F.col("fp"), n), "fpr_judgeable_only": ratio(F.col("fp"), judged),
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    })


def frame_faults(frame: DataFrame) -> DataFrame:
    """Contract violations of an evaluation frame, one row per kind and run."""
    per_run = frame.groupBy("run_id").agg(
        F.count_distinct("grp").alias("n_grp"), F.max("grp").alias("grp"), F.max("fault").alias("fault"),
        F.count_if("y").alias("n_y"), (F.max(F.when(F.col("y"), F.col("tick"))) - F.min(F.when(F.col("y"), F.col("tick"))) + 1).alias("span"),
        F.count_if(F.col("alarm") & ~F.col("judgeable")).alias("n_blind_alarms"),
        (F.count(F.lit(1)) - F.count_distinct("tick")).alias("n_repeated"),
    )
    control, faulty = F.col("grp") == "C", F.col("grp") == "F"
    kinds = F.filter(F.array(
        F.when(F.col("n_grp") != 1, "group"), F.when(control & ((F.col("n_y") > 0) | F.col("fault").isNotNull()), "control_with_fault"),
        F.when(faulty & F.col("fault").isNull(), "fault_missing"), F.when(faulty & ((F.col("n_y") == 0) | (F.col("span") != F.col("n_y"))), "y_block"),
        F.when(F.col("n_blind_alarms") > 0, "alarm_unjudgeable"), F.when(F.col("n_repeated") > 0, "repeated_key"),
    ), lambda x: x.isNotNull())
    return per_run.select("run_id", F.explode(kinds).alias("kind"))


def detection_delay(frame: DataFrame) -> DataFrame:
    """Ticks from onset to the first alarm inside the window; NULL when never detected."""
    window = frame.where((F.col("grp") == "F") & F.col("y"))
    return window.groupBy("run_id").agg(
        (F.min(F.when(F.col("alarm") & F.col("in_eval"), F.col("tick"))) - F.min("tick")).alias("delay")
    )


def verdict(op: Column, value: Column, target: Column) -> Column:
    met = F.when(op == ">=", value >= target).when(op == "<=", value <= target).when(op == "==", value == target)
    return F.when(value.isNull(), "NO_DATA").when(met, "PASS").otherwise("FAIL")


def all_true(flag: Column) -> Column:
    """Fail closed: nothing measured, or any NULL, is no pass."""
    return F.coalesce(F.bool_and(F.coalesce(flag, F.lit(False))), F.lit(False))
