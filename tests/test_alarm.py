"""Latch form of the alarm machine against a step-by-step reference walk written for the test."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import alarm as A
from gaugeline.operators import capacity as P
from gaugeline.operators import freshness as R
from gaugeline.operators import scan as S

SCHEMA = "run string, tick long, status string, suspect boolean, act boolean, held boolean"


def walk(rows, rule):
    """Plain state machine over (status, suspect, act, held)."""
    state, level_act, level_sus, ca, cs, calm, out = "warming_up", False, False, 0, 0, 0, []
    for status, suspect, act, held in rows:
        loud = suspect or act
        if status != "scored" or (held and loud):
            ca = cs = calm = 0
            level_act = level_sus = False
            state = "warming_up" if status == "warming_up" else "unknown"
        else:
            ca, cs, calm = (ca + 1 if act else 0), (cs + 1 if loud else 0), (0 if loud else calm + 1)
            if calm >= rule.release_m:
                level_act = level_sus = False
            level_act |= ca >= rule.n_act
            level_sus |= cs >= rule.n_suspect
            state = "act" if level_act else "suspect" if level_sus else "normal"
        out.append(state)
    return out


@pytest.mark.parametrize("rule,width", [(A.Debounce(), 4), (A.Debounce(2, 3, 4), 1), (A.Debounce(3, 1, 2), 50)])
def test_states_equal_walk(spark, rule, width):
    rng = random.Random(str(rule))
    runs = {f"r{i}": [(rng.choices(["scored", "unknown", "warming_up"], [12, 1, 1])[0], rng.random() < 0.4, rng.random() < 0.3, rng.random() < 0.1) for _ in range(60)] for i in range(12)}
    df = spark.createDataFrame([(k, t, *row) for k, rows in runs.items() for t, row in enumerate(rows)], SCHEMA).repartition(7)
    got = A.states(df, ["run"], ["tick"], S.tick_chunk("tick", width), rule, suppressed=F.col("held")).select("run", "tick", "state").collect()
    states = {(r.run, r.tick): r.state for r in got}
    for k, rows in runs.items():
        assert [states[(k, t)] for t in range(len(rows))] == walk(rows, rule)


def test_release_must_outlast_act():
    with pytest.raises(ValueError):
        A.Debounce(1, 3, 3)


def test_rejected_rows_keep_the_carried_state(spark):
    rows = [("r", 0, "warming_up", False, False, False), ("r", 1, "scored", True, False, False), ("r", 2, "rejected", False, False, False), ("r", 3, "scored", False, False, False)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = A.states(df, ["run"], ["tick"], S.tick_chunk("tick", 2)).orderBy("tick").collect()
    assert [r.state for r in out] == ["warming_up", "suspect", "suspect", "suspect"]
    assert [(r.prev, r.entry) for r in out] == [("warming_up", False), ("warming_up", True), ("suspect", False), ("suspect", False)]


def test_guard_keeps_state_on_missing_load(spark):
    loads = [1.0, 9.0, None, 5.0, 5.0, None, 5.0, 5.0]
    df = spark.createDataFrame([("r", t, v) for t, v in enumerate(loads)], "run string, tick long, load double")
    got = A.range_guard(df, ["run"], ["tick"], S.tick_chunk("tick", 3), "load", F.lit(5.0), 3).orderBy("tick").collect()
    assert [r.guard for r in got] == [False, True, True, True, True, True, False, False]


def test_order_check_verdicts(spark):
    rows = [(1, 10.0, "a"), (2, 11.0, "b"), (3, 11.0, "b"), (4, 11.0, "c"), (5, 9.0, "a"), (6, None, "x"), (7, 12.0, "d")]
    df = spark.createDataFrame([("r", *r) for r in rows], "run string, seq long, t double, digest string")
    got = A.accepted(df, ["run"], ["seq"], S.tick_chunk("seq", 2), "t", "digest").orderBy("seq").collect()
    assert [r.verdict for r in got] == ["accepted", "accepted", "duplicate", "conflict", "late", "invalid", "accepted"]


def test_oscillation_figures(spark):
    paths = {"calm": ["normal", "suspect", "act", "act", "normal"], "bounce": ["act", "normal", "act"], "blind": ["act", "unknown", "act"], "return": ["suspect", "act", "unknown", "suspect"]}
    df = spark.createDataFrame([(k, t, s) for k, p in paths.items() for t, s in enumerate(p)], "run string, tick long, state string")
    got = {r.run: (r.act_entries, r.reescalations, r.v1_violations) for r in A.entries_and_rises(df, ["run"], ["tick"], S.tick_chunk("tick", 2)).collect()}
    assert got == {"calm": (1, 0, 0), "bounce": (2, 1, 1), "blind": (2, 0, 0), "return": (1, 0, 1)}


def test_monotone_reads(spark):
    steps = [("a", 5, True), ("a", 5, False), ("a", 6, True), ("b", 1, True), ("a", 9, False), ("b", 1, False), ("b", 2, True), ("c", 0, True), ("b", 7, False)]
    df = spark.createDataFrame([("u", i, b, s) for i, (b, s, _) in enumerate(steps)], "key string, i long, boot string, seq long")
    got = R.monotone(df, ["key"], ["i"], S.tick_chunk("i", 2), "boot", "seq", "i").orderBy("i").collect()
    assert [r.accepted for r in got] == [ok for _, _, ok in steps]
    assert got[0].confirmed_at is None and got[2].confirmed_at == 2


def test_capacity_skips_untrusted_rows(spark):
    rho = [0.9, 0.9, None, 0.9, 0.1, 0.1, 0.1]
    df = spark.createDataFrame([("r", t, v, False) for t, v in enumerate(rho)], "run string, tick long, rho double, down boolean")
    got = P.wanted_level(df, ["run"], ["tick"], S.tick_chunk("tick", 2), "rho", "down", F.col("rho").isNotNull()).orderBy("tick").collect()
    assert [r.load for r in got] == [0, 0, 1, 1, 1, 0]
