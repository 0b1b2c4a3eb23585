"""Stateful steps per key: the alarm machine, guard and deltas.

One processor keeps one small dictionary per key and folds the rows of a batch through a step
function in event-time order. A row that is not later than the last one taken is rejected and
leaves the state alone; the rejection is part of the output, not dropped in silence. A batch has few
rows of a key, so rows are handed over as they are: a data frame per key costs far more than the step.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Step = Callable[[dict, dict], dict]


class Folding(StatefulProcessor):
    """Fold rows through ``step(state, row) -> output``; ``state`` is changed in place."""

    def __init__(self, step: Step, order: str, outputs: list[str]):
        self.step, self.order, self.outputs = step, order, outputs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "body string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.kept.get()
        state = {} if kept is None else json.loads(kept[0])
        for row in sorted((r.asDict() for r in rows), key=lambda r: r[self.order]):
            at = row[self.order]
            if "_at" in state and at <= state["_at"]:
                result = {"rejected": True}
            else:
                result = {"rejected": False, **self.step(state, row)}
                state["_at"] = at
            told = {**row, **result}
            yield Row(**{name: told.get(name) for name in self.outputs})
        self.kept.update((json.dumps(state),))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.kept.update((initialState["body"],))

    def close(self) -> None:
        pass


def fold(stream: DataFrame, keys: list[str], step: Step, order: str, schema: str, outputs: list[str], initial: DataFrame | None = None) -> DataFrame:
    """``initial`` (keys, body) is the state that a new stream starts from, as :func:`stored_state` reads it."""
    begin = None if initial is None else initial.groupBy(*keys)
    return stream.groupBy(*keys).transformWithState(Folding(step, order, outputs), schema, "Append", "None", initialState=begin)


def stored_state(spark: SparkSession, checkpoint: str, keys: list[str], batch: int | None = None) -> DataFrame:
    """(keys, body): the state that a folded stream left in its checkpoint, at its end or after a batch."""
    reader = spark.read.format("statestore").option("stateVarName", "kept")
    reader = reader if batch is None else reader.option("batchId", batch)
    return reader.load(checkpoint).select(*[F.col(f"key.{k}").alias(k) for k in keys], F.col("value.body").alias("body"))


def alarm_step(n_suspect: int = 1, n_act: int = 2, release_m: int = 3) -> Step:
    """Same latches as the batch form: set by a streak, cleared by calm or by a blind reading."""

    def step(state: dict, row: dict) -> dict:
        prev = state.get("state", "warming_up")
        blind = row["status"] != "scored"
        act, alarm = not blind and row["act"], not blind and (row["act"] or row["suspect"])
        for name, on in (("ca", act), ("cs", alarm), ("calm", not blind and not alarm)):
            state[name] = state.get(name, 0) + 1 if on else 0
        clear = blind or state["calm"] >= release_m
        for latch, on in (("A", state["ca"] >= n_act), ("S", state["cs"] >= n_suspect)):
            state[latch] = on or (state.get(latch, False) and not clear)
        level = "act" if state["A"] else "suspect" if state["S"] else "normal"
        state["state"] = "warming_up" if row["status"] == "warming_up" else "unknown" if blind else level
        return {"state": state["state"], "prev": prev}

    return step


def replayed(step: Step, warm: int = 1, max_gap: int = 1) -> Step:
    """A step whose status follows the rule: the first ``warm`` readings since there is a state are
    warming_up, one more than ``max_gap`` ticks after the last is unknown, and so is one that is not usable."""

    def ruled(state: dict, row: dict) -> dict:
        seen, gap = state.get("seen", 0), row["tick"] - state["_at"] if "_at" in state else 0
        status = "warming_up" if seen < warm else "unknown" if gap > max_gap or not row["usable"] else "scored"
        state["seen"] = seen + 1
        return {"status": status, **step(state, {**row, "status": status})}

    return ruled


def guard_step(limit: float, exit_ticks: int = 3) -> Step:
    def step(state: dict, row: dict) -> dict:
        load = row["load"]
        if load is not None and load == load:
            over = load > limit
            state["quiet"] = 0 if over else state.get("quiet", 0) + 1
            state["on"] = over or (state.get("on", False) and state["quiet"] < exit_ticks)
        return {"guard": state.get("on", False)}

    return step


def delta_step(tolerance: float, refresh: int) -> Step:
    def step(state: dict, row: dict) -> dict:
        last, now = state.get("value"), math.nan if row["value"] is None else row["value"]
        state["value"] = now
        return {"send": last is None or abs(now - last) >= tolerance or row["tick"] % refresh == 0}

    return step
