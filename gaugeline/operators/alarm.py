"""Alarm machine over ordered readings, as a finite machine of composed maps; guard and ordered ingest as latches.

States: warming_up, normal, suspect, act, unknown. A reading that is not scored, or is
suppressed, clears everything. ``act`` is set after n_act acting readings in a row, ``suspect``
after n_suspect alarming ones, and both are cleared by release_m calm readings in a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import automata as M
from gaugeline.operators import scan as S

ALARM = ("suspect", "act")


@dataclass(frozen=True)
class Debounce:
    n_suspect: int = 1
    n_act: int = 2
    release_m: int = 3

    def __post_init__(self):
        if min(self.n_suspect, self.n_act, self.release_m) < 1 or self.release_m <= self.n_act:
            raise ValueError("counts must be positive and release_m above n_act")


WARMING, BLIND, CALM, SUSPECT, ACT = range(5)


def machine(rule: Debounce) -> M.Automaton:
    """The alarm machine: both latches and the three streaks, each counted as far as the rule looks."""

    def step(state: tuple, symbol: int) -> tuple:
        if symbol in (WARMING, BLIND):
            return ("warming_up" if symbol == WARMING else "unknown", False, False, 0, 0, 0)
        _, act, suspect, n_act, n_loud, n_calm = state
        n_act = min(n_act + 1, rule.n_act) if symbol == ACT else 0
        n_loud = 0 if symbol == CALM else min(n_loud + 1, rule.n_suspect)
        n_calm = min(n_calm + 1, rule.release_m) if symbol == CALM else 0
        free = n_calm >= rule.release_m
        act, suspect = n_act >= rule.n_act or (act and not free), n_loud >= rule.n_suspect or (suspect and not free)
        return ("act" if act else "suspect" if suspect else "normal", act, suspect, n_act, n_loud, n_calm)

    return M.Automaton.of(("warming_up", False, False, 0, 0, 0), 5, step, lambda state: state[0])


def symbol(suspect: Column, act: Column, suppressed: Column | None = None) -> Column:
    """Step of a reading with ``status``; a rejected one is none."""
    alarming = suspect | act
    live = F.col("status") == "scored"
    live = live if suppressed is None else live & ~(F.coalesce(suppressed, F.lit(False)) & alarming)
    heard = F.when(F.coalesce(act, F.lit(False)), ACT).when(F.coalesce(suspect, F.lit(False)), SUSPECT).otherwise(CALM)
    return F.when(F.col("status") == "rejected", F.lit(None)).when(F.col("status") == "warming_up", WARMING).when(live, heard).otherwise(BLIND)


def states(
    readings: DataFrame, keys: list[str], order: list[str], chunk: Column,
    rule: Debounce = Debounce(), suppressed: Column | None = None,
) -> DataFrame:
    """Add ``state``, ``prev`` (warming_up before the first reading), ``changed`` and ``entry`` to readings
    with columns status, suspect, act. A rejected reading is no step and keeps the state it arrives in."""
    out = M.run(readings, keys, order, chunk, {"state": (machine(rule), symbol(F.col("suspect"), F.col("act"), suppressed))})
    return out.withColumnRenamed("state_prev", "prev").withColumns(moves("state", "prev"))


def channels(readings: DataFrame, keys: list[str], order: list[str], chunk: Column, symbols: dict[str, Column], rule: Debounce = Debounce()) -> DataFrame:
    """Several machines on the same readings in one pass: ``name`` and ``name_prev`` for each symbol."""
    return M.run(readings, keys, order, chunk, {name: (machine(rule), s) for name, s in symbols.items()})


def with_status(rows: DataFrame, keys: list[str], order: list[str], chunk: Column, at: str, unusable: Column, warm: int = 1, max_gap: int = 1) -> DataFrame:
    """Add ``status`` and ``cause`` of accepted readings by the rule: the first ``warm`` of a key are
    warming_up, one that is more than ``max_gap`` after the one before is unknown, so is one that
    cannot be judged; the others are scored. A restart or a cut needs nothing else."""
    told = S.scan(rows, keys, order, chunk, True, _i=S.count(before=True), _p=S.previous(F.col(at)))
    cause = F.when(F.col("_i") < warm, "start").when(F.col(at) - F.col("_p") > max_gap, "gap").when(unusable, "missing")
    status = F.when(cause == "start", "warming_up").when(cause.isNotNull(), "unknown").otherwise("scored")
    return told.withColumns({"cause": cause, "status": status}).drop("_i", "_p")


def moves(state: str, prev: str) -> dict[str, Column]:
    return {"changed": F.col(state) != F.col(prev), "entry": F.col(state).isin(*ALARM) & ~F.col(prev).isin(*ALARM)}


def transitions(trace: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Add ``prev`` (warming_up before the first reading), ``changed`` and ``entry``."""
    out = S.scan(trace, keys, order, chunk, True, _p=S.previous(F.col("state")))
    out = out.withColumn("prev", F.coalesce("_p", F.lit("warming_up"))).drop("_p")
    return out.withColumns(moves("state", "prev"))


def range_guard(df: DataFrame, keys: list[str], order: list[str], chunk: Column, load: str, limit: Column, exit_ticks: int, name: str = "guard") -> DataFrame:
    """On when the load passes the limit, off after ``exit_ticks`` calm readings in a row; a
    missing load keeps the state and neither counts nor breaks the calm streak."""
    df = df.withColumn("_lim", limit)
    known = S.streaks(df.where(F.col(load).isNotNull()), keys, order, chunk, {"_quiet": F.col(load) <= F.col("_lim")}, settle=True)
    rows = known.unionByName(df.where(F.col(load).isNull()), allowMissingColumns=True)
    latch = F.when(F.col(load) > F.col("_lim"), 1).when(F.col("_quiet") >= exit_ticks, 0)
    out = S.scan(rows, keys, order, chunk, _on=S.last_known(latch))
    return out.withColumn(name, F.coalesce(F.col("_on") == 1, F.lit(False))).drop("_lim", "_quiet", "_on")


def accepted(df: DataFrame, keys: list[str], arrival: list[str], chunk: Column, event_time: str, digest: str) -> DataFrame:
    """Order check on arrival: ``verdict`` accepted, duplicate (same time and content as the last
    accepted), conflict (same time, other content), late (earlier) or invalid (no time)."""
    ordered = S.scan(df.withColumn("_k", chunk), keys, arrival, "_k", True, _top=S.highest(F.col(event_time), before=True))
    t, top = F.col(event_time), F.col("_top")
    kind = F.when(t.isNull(), "invalid").when(top.isNull() | (t > top), "accepted").when(t < top, "late").otherwise("same")
    marked = ordered.withColumn("_kind", kind)
    holder = S.scan(marked, keys, arrival, "_k", _d=S.last_known(F.when(F.col("_kind") == "accepted", F.col(digest)), before=True))
    verdict = F.when(F.col("_kind") != "same", F.col("_kind")).when(F.col("_d") == F.col(digest), "duplicate").otherwise("conflict")
    return holder.withColumn("verdict", verdict).drop("_top", "_kind", "_d", "_k")


def entries_and_rises(trace: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Oscillation figures per key: entries into act on the raw sequence, rises of severity after
    a fall, and returns A-B-A on the sequence without repeats and blind readings."""
    raw = S.scan(trace, keys, order, chunk, _p=S.previous(F.col("state")))
    acts = raw.groupBy(*keys).agg(F.count_if((F.col("state") == "act") & ~F.col("_p").eqNullSafe(F.lit("act"))).alias("act_entries"))
    seen = trace.where(F.col("state").isin("normal", "suspect", "act"))
    moves = S.scan(seen, keys, order, chunk, True, _p=S.previous(F.col("state"))).where(~F.col("_p").eqNullSafe(F.col("state")))
    rank = lambda c: F.when(c == "act", 2).when(c == "suspect", 1).when(c == "normal", 0)
    fell = rank(F.col("state")) < rank(F.col("_p"))
    path = S.scan(moves, keys, order, chunk, _fallen=S.highest(fell.cast("int"), before=True), _pp=S.previous(F.col("_p")))
    found = path.groupBy(*keys).agg(
        F.count_if((rank(F.col("state")) > rank(F.col("_p"))) & (F.col("_fallen") == 1)).alias("reescalations"),
        F.count_if((F.col("_pp") == F.col("state")) & F.col("state").isin(*ALARM)).alias("v1_violations"),
    )
    return acts.join(found, keys, "left").na.fill(0, ["reescalations", "v1_violations"])
