"""Composed maps equal a walk row by row, whatever the chunks and Arrow batches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import automata as M
from gaugeline.operators import scan as S


def mod(n):
    """Counts to n over symbols 0 (add one), 1 (double), 2 (reset)."""
    return M.Automaton.of(0, 3, lambda s, x: [(s + 1) % n, 2 * s % n, 0][x], str)


@pytest.mark.parametrize("width, batch", [(1, 10_000), (7, 3), (50, 11), (10_000, 4)])
def test_two_machines_equal_their_walks(spark, width, batch):
    pick = random.Random(width)
    rows = [(k, t, pick.choice([0, 0, 0, 1, 2, None]), pick.choice([0, 1])) for k in ("a", "b", None, "c") for t in range(150 if k == "a" else 20)]
    df = spark.createDataFrame(rows, "key string, t bigint, x int, y int").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {(r.key, r.t): (r.p, r.p_prev, r.q, r.q_prev) for r in M.run(df, ["key"], ["t"], S.tick_chunk("t", width), {"p": (mod(7), F.col("x")), "q": (mod(5), F.col("y"))}).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    step = lambda s, x, n: s if x is None else [(s + 1) % n, 2 * s % n, 0][x]
    state = {}
    for k, t, x, y in rows:
        p, q = state.get(k, (0, 0))
        state[k] = new = step(p, x, 7), step(q, y, 5)
        assert got[(k, t)] == (str(new[0]), str(p), str(new[1]), str(q))
    assert len(got) == len(rows)


def test_an_empty_table_and_too_many_states(spark):
    df = spark.createDataFrame([], "key string, t bigint, x int")
    assert M.run(df, ["key"], ["t"], S.tick_chunk("t"), {"p": (mod(3), F.col("x"))}).columns == ["key", "t", "x", "p", "p_prev"]
    assert M.run(df, ["key"], ["t"], S.tick_chunk("t"), {"p": (mod(3), F.col("x"))}).count() == 0
    with pytest.raises(ValueError):
        mod(300)


def test_rows_are_dealt_once(spark):
    df = spark.createDataFrame([("a", 1, 0)], "key string, t bigint, x int")
    out = M.run(df, ["key"], ["t"], S.tick_chunk("t"), {n: (mod(4), F.col("x")) for n in "pqrs"})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and "Window" not in plan


def test_maps_compose_from_the_left():
    maps = np.array([[[1, 0, 2]], [[0, 2, 1]], [[2, 2, 2]], [[1, 1, 0]]], np.uint8)
    got = M.composed(maps, np.array([True, False, False, True]), None)
    assert got[:, 0].tolist() == [[1, 0, 2], [2, 0, 1], [2, 2, 2], [1, 1, 0]]
    assert M.composed(maps[:1], np.array([False]), np.array([[2, 1, 0]], np.uint8))[0, 0].tolist() == [2, 0, 1]
