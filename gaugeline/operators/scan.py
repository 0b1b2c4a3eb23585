"""Running values over ordered rows, split into chunks.

A plain window over one key puts all rows of that key into one task. Here every key is cut
into chunks along its order (tick ranges, time buckets, value buckets). Each chunk gets its
own window, each chunk is also reduced to one summary row, and a window over the summary rows
gives the value carried into the chunk. The large side is shuffled once on (keys, chunk), and
no task holds more than one chunk of detail rows. Keys and chunk are one struct column: it is never
NULL, NULL keys are equal inside it, and window and carry join need the same plain hash of it.

Both passes start from the same input, so a chain of k scans would read its source 2^k times.
With ``settle=True`` the small carry table is written to the shared folder first; a chain then
reads its source k + 1 times, and the written table has a known size for the join.

``chunk`` may also name a column of the input. It comes back as that struct, and a following scan
on the same keys and column finds its rows already in place and does not shuffle them again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.session import cut_lineage

TICKS_PER_CHUNK = 4096
CHUNK = "_chunk"


@dataclass(frozen=True)
class Running:
    """One running value. ``before`` leaves the current row out."""

    how: str
    value: Column
    before: bool = False


def total(value: Column, before: bool = False) -> Running:
    return Running("sum", value, before)


def count(before: bool = False) -> Running:
    return Running("sum", F.lit(1).cast("bigint"), before)


def highest(value: Column, before: bool = False) -> Running:
    return Running("max", value, before)


def lowest(value: Column, before: bool = False) -> Running:
    return Running("min", value, before)


def last_known(value: Column, before: bool = False) -> Running:
    """Last value that is not NULL."""
    return Running("last", value, before)


def previous(value: Column) -> Running:
    """Value of the row before, NULL included."""
    return Running("prev", value)


def following(value: Column) -> Running:
    """Value of the row after, NULL included."""
    return Running("next", value)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join in which a NULL key meets a NULL key; the key columns of ``left`` remain. Both sides are
    dealt by one struct of the keys."""
    key = F.struct(*[F.col(k).alias(k) for k in keys])
    renamed = right.select(key.alias("_key"), *[c for c in right.columns if c not in keys])
    return left.withColumn("_key", key).join(renamed, "_key", how).drop("_key")


def tick_chunk(tick: str | Column, width: int = TICKS_PER_CHUNK) -> Column:
    column = F.col(tick) if isinstance(tick, str) else tick
    return F.floor(column / F.lit(width)).cast("bigint")


def even_width(df: DataFrame, keys: list[str], at: str, rows_per_chunk: int = 500_000) -> float:
    """Chunk width along ``at`` for the most crowded key: one pass over two columns gives rows
    and span per key, and only the largest density comes back. Crowded data gets narrow chunks,
    sparse data one chunk per key."""
    position = F.col(at).cast("double")
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max(position) - F.min(position)).alias("span"))
    dense = grouped.where("span > 0").agg(F.max(F.col("n") / F.col("span")).alias("d")).first()["d"]
    return float(rows_per_chunk) / dense if dense else float("inf")


def range_chunk(at: str | Column, width: float) -> Column:
    """Chunk number for a width from :func:`even_width`; an infinite width is one chunk."""
    column = F.col(at) if isinstance(at, str) else at
    return F.lit(0).cast("bigint") if width == float("inf") else F.floor(column / F.lit(width)).cast("bigint")


def _place(df: DataFrame, keys: list[str], chunk: Column | str) -> tuple[DataFrame, str]:
    """``df`` with keys and chunk in one struct, and the name of that column."""
    name, number = (chunk, F.col(chunk)) if isinstance(chunk, str) else (CHUNK, chunk)
    if isinstance(chunk, str) and isinstance(df.schema[chunk].dataType, T.StructType):
        if df.schema[chunk].dataType.names == [*keys, CHUNK]:
            return df, name
        number = number[CHUNK]
    return df.withColumn(name, F.struct(*[F.col(k).alias(k) for k in keys], number.alias(CHUNK))), name


def _across(keys: list[str], at: str):
    return Window.partitionBy(*[F.col(at)[k] for k in keys]).orderBy(F.col(at)[CHUNK])


def _frame(window, before: bool):
    return window.rowsBetween(Window.unboundedPreceding, -1 if before else 0)


def scan(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column | str, settle: bool = False, **specs: Running
) -> DataFrame:
    """``df`` with one more column per spec. ``order`` must be a total order inside a key and
    ``chunk`` must not fall along it."""
    df, at = _place(df, keys, chunk)
    inside = Window.partitionBy(at).orderBy(*order)
    across = _across(keys, at)
    position = F.struct(*order)

    local, reduced, carried, result = [], [], [], {}
    for name, spec in specs.items():
        l, s, c = f"_l_{name}", f"_s_{name}", f"_c_{name}"
        past = across.rowsBetween(Window.unboundedPreceding, -1)
        if spec.how == "sum":
            local.append(F.sum(spec.value).over(_frame(inside, spec.before)).alias(l))
            reduced.append(F.sum(spec.value).alias(s))
            carried.append(F.sum(s).over(past).alias(c))
            zero = F.lit(0)
            result[name] = F.coalesce(F.col(l), zero) + F.coalesce(F.col(c), zero)
        elif spec.how in ("max", "min"):
            pick, join = (F.max, F.greatest) if spec.how == "max" else (F.min, F.least)
            local.append(pick(spec.value).over(_frame(inside, spec.before)).alias(l))
            reduced.append(pick(spec.value).alias(s))
            carried.append(pick(s).over(past).alias(c))
            result[name] = join(F.col(l), F.col(c))
        elif spec.how == "last":
            local.append(F.last(spec.value, ignorenulls=True).over(_frame(inside, spec.before)).alias(l))
            reduced.append(F.max_by(spec.value, F.when(spec.value.isNotNull(), position)).alias(s))
            carried.append(F.last(s, ignorenulls=True).over(past).alias(c))
            result[name] = F.coalesce(F.col(l), F.col(c))
        elif spec.how == "prev":
            boxed = F.struct(spec.value.alias("v"))
            local.append(F.lag(boxed).over(inside).alias(l))
            reduced.append(F.max_by(boxed, position).alias(s))
            carried.append(F.lag(s).over(across).alias(c))
            result[name] = F.coalesce(F.col(l), F.col(c))["v"]
        elif spec.how == "next":
            boxed = F.struct(spec.value.alias("v"))
            local.append(F.lead(boxed).over(inside).alias(l))
            reduced.append(F.min_by(boxed, position).alias(s))
            carried.append(F.lead(s).over(across).alias(c))
            result[name] = F.coalesce(F.col(l), F.col(c))["v"]
        else:
            raise ValueError(f"unknown running value: {spec.how}")

    summary = df.groupBy(at).agg(*reduced)
    carry = summary.select(at, *carried)
    if settle:
        carry = cut_lineage(carry)
    detail = df.select("*", *local)
    joined = detail.join(carry, at, "left")
    kept = [c for c in df.columns if c != CHUNK and c not in specs]
    return joined.select(*kept, *[value.alias(name) for name, value in result.items()])


def streaks(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column | str,
    conditions: dict[str, Column], index: str | None = None, settle: bool = False,
) -> DataFrame:
    """Length of the current run of consecutive rows on which each condition holds (0 where it
    does not), and on request the 0-based row index inside the key. A NULL condition breaks."""
    flags = {f"_b_{name}": F.coalesce(cond, F.lit(False)) for name, cond in conditions.items()}
    df, at = _place(df.withColumns(flags) if flags else df, keys, chunk)
    inside = Window.partitionBy(at).orderBy(*order)
    across = _across(keys, at)
    past = across.rowsBetween(Window.unboundedPreceding, -1)

    placed = df.withColumn("_pos", F.row_number().over(inside).cast("bigint"))
    breaks = {name: F.when(~F.col(f"_b_{name}"), F.col("_pos")) for name in conditions}
    summary = placed.groupBy(at).agg(
        F.count(F.lit(1)).alias("_n"), *[F.max(b).alias(f"_x_{n}") for n, b in breaks.items()]
    )
    summary = summary.withColumn("_before", F.coalesce(F.sum("_n").over(past), F.lit(0)))
    carry = summary.select(
        at, "_before",
        *[
            (F.col("_before") - F.coalesce(F.max(F.col("_before") + F.col(f"_x_{n}")).over(past), F.lit(0)))
            .alias(f"_c_{n}")
            for n in conditions
        ],
    )
    if settle:
        carry = cut_lineage(carry)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    detail = placed.select("*", *[F.max(b).over(running).alias(f"_r_{n}") for n, b in breaks.items()])
    joined = detail.join(carry, at, "left")
    out = {
        n: F.when(F.col(f"_r_{n}").isNull(), F.col("_pos") + F.col(f"_c_{n}"))
        .otherwise(F.col("_pos") - F.col(f"_r_{n}"))
        for n in conditions
    }
    if index:
        out[index] = F.col("_before") + F.col("_pos") - 1
    kept = [c for c in df.columns if c != CHUNK and c not in flags and c not in out]
    return joined.select(*kept, *[v.alias(n) for n, v in out.items()])


def row_index(df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str = "idx", settle: bool = False) -> DataFrame:
    """0-based position of each row inside its key."""
    return streaks(df, keys, order, chunk, {}, index=name, settle=settle)


def lookback(
    df: DataFrame, keys: list[str], index: str, back: int, width: int = TICKS_PER_CHUNK
) -> tuple[DataFrame, list[str], Column]:
    """Cut rows into ranges of a gap-free ``index`` and repeat the last ``back`` rows of each
    range in the next one, so a frame of at most ``back`` rows never leaves its range.

    Returns the frame, the partition columns and the filter that drops the repeated rows; the
    caller runs its windows in between. A range is never shorter than the look-back."""
    width = max(width, back)
    home = F.floor(F.col(index) / width).cast("bigint")
    last_rows = F.col(index) % width >= width - back
    spread = df.withColumn("_home", home).withColumn(
        "_range", F.explode(F.when(last_rows, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    return spread, [*keys, "_range"], F.col("_range") == F.col("_home")


def islands(df: DataFrame, keys: list[str], tick: str, chunk: Column | None = None) -> DataFrame:
    """Number the groups of adjacent ticks: rows whose ticks follow each other by one share
    ``island`` (one row per key and tick is expected)."""
    placed = row_index(df, keys, [tick], chunk if chunk is not None else tick_chunk(tick), "_i")
    return placed.withColumn("island", F.col(tick) - F.col("_i")).drop("_i")


def segments(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: str, name: str = "segment"
) -> DataFrame:
    """Number the stretches of equal consecutive values, from 1."""
    marked = scan(df.withColumn("_k", chunk), keys, order, "_k", True, _prev=previous(F.struct(F.col(value).alias("x"))))
    change = F.when(F.col("_prev").isNull() | ~F.col("_prev.x").eqNullSafe(F.col(value)), 1).otherwise(0)
    return scan(marked, keys, order, "_k", **{name: total(change)}).drop("_prev", "_k")
