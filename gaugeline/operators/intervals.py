"""Interval accounting: merge, clip, overlap, gaps, leases, owners of points in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import scan as S


def lease_end(start: Column, revert: Column, cooldown: float, max_open: float) -> Column:
    """A closed intervention stays active through its cooldown; an open one is a lease."""
    return F.coalesce(revert + F.lit(cooldown), start + F.lit(max_open))


def active_until(kind: Column, start: Column, revert: Column, cooldown: float, max_open: float) -> Column:
    """End of activity by kind: a transient act lasts its cooldown; a lasting one its cooldown after
    the revert, or its lease while it has none."""
    return F.when(kind == "transient", start + F.lit(cooldown)).otherwise(lease_end(start, revert, cooldown, max_open))


def all_covered(violating: DataFrame, spans: DataFrame, keys: list[str], at: str, entity: str, start: str, end: str, radius: str, width: float | None = None) -> DataFrame:
    """Per (keys, at) the violating entities, how many lie in the union of the radii of the active
    spans, and ``suppressed``: there are some and all lie in it.

    ``violating`` has a row per entity, ``spans`` an array ``radius``. Each (point, entity) asks one sweep
    per entity how many spans hold it; the subset test is a count, so no point meets the spans."""
    covering = spans.select(*keys, F.explode(radius).alias(entity), start, end)
    asked = active_counts(violating.select(*keys, at, entity).distinct(), covering, [*keys, entity], at, start, end, width, "_n")
    out = asked.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("n_violating"), F.count_if(F.col("_n") > 0).alias("n_covered"))
    return out.withColumn("suppressed", F.col("n_covered") == F.col("n_violating"))


def clip(df: DataFrame, start: str, end: str, lo: Column, hi: Column) -> DataFrame:
    cut = df.withColumn(start, F.greatest(F.col(start), lo)).withColumn(end, F.least(F.col(end), hi))
    return cut.where(F.col(end) > F.col(start))


def merge(df: DataFrame, keys: list[str], start: str, end: str, width: float | None = None) -> DataFrame:
    """Union of overlapping or touching intervals per key. ``width`` is the time range per chunk,
    taken from the data when it is not given."""
    unique = df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).groupBy(*keys, "_s").agg(F.max("_e").alias("_e"))
    chunk = S.range_chunk("_s", width or S.even_width(unique, keys, "_s"))
    reach = S.scan(unique.withColumn("_k", chunk), keys, ["_s"], "_k", True, _reach=S.highest(F.col("_e"), before=True))
    opens = F.when(F.col("_reach").isNull() | (F.col("_s") > F.col("_reach")), 1).otherwise(0)
    numbered = S.scan(reach, keys, ["_s"], "_k", _span=S.total(opens))
    return numbered.groupBy(*keys, "_span").agg(F.min("_s").alias(start), F.max("_e").alias(end)).drop("_span")


def active_counts(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: float | None = None, name: str = "n_active") -> DataFrame:
    """Number of intervals [start, end) that hold each point, by one sweep over sorted edges: no
    point meets an interval in a join, so a crowded key costs its size and not its pairs."""
    edges = spans.select(*keys, F.explode(F.array(
        F.struct(F.col(start).cast("double").alias("_at"), F.lit(1).alias("_step")),
        F.struct(F.col(end).cast("double").alias("_at"), F.lit(-1).alias("_step")),
    )).alias("_x")).select(*keys, "_x._at", "_x._step").groupBy(*keys, "_at").agg(F.sum("_step").alias("_step"))
    times = points.select(*keys, F.col(at).cast("double").alias("_at")).distinct()
    moves = edges.unionByName(times.withColumn("_step", F.lit(0).cast("bigint")))
    merged = moves.groupBy(*keys, "_at").agg(F.sum("_step").alias("_step"))
    chunk = S.range_chunk("_at", width or S.even_width(merged, keys, "_at"))
    swept = S.scan(merged, keys, ["_at"], chunk, True, **{name: S.total(F.col("_step"))})
    return S.join_null_safe(points.withColumn("_at", F.col(at).cast("double")), swept.drop("_step"), [*keys, "_at"]).drop("_at")


def owners(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, columns: list[str], width: float | None = None) -> DataFrame:
    """Each point with the earliest-started interval [start, end) that holds it, as ``owner``.

    In start order an interval owns what the furthest end before it leaves over: any earlier
    interval that reaches past t started before t and so holds t. The owned stretches do not
    overlap, one running maximum yields them, and a point finds its own by the nearest start."""
    from gaugeline.operators.matching import as_of

    best = F.min(F.struct(*columns, F.col(end).alias("_e")))
    longest = spans.where(F.col(end) > F.col(start)).groupBy(*keys, F.col(start).cast("double").alias("_s"), F.col(end).cast("double").alias("_end")).agg(best.alias("_first"))
    chunk = S.range_chunk("_s", width or S.even_width(longest, keys, "_s"))
    order = ["_s", "_first", "_end"]
    reach = S.scan(longest, keys, order, chunk, True, _reach=S.highest(F.col("_end"), before=True))
    owned = reach.withColumn("_from", F.greatest("_s", "_reach")).where(F.col("_end") > F.col("_from"))
    stretch = owned.select(*keys, F.col("_from").alias(at), F.col("_end"), F.struct(F.col("_s").alias(start), *[F.col(f"_first.{c}").alias(c) for c in columns]).alias("_o"))
    asked = points.withColumn("_t", F.col(at).cast("double"))
    found = as_of(asked, stretch.withColumnRenamed(at, "_t"), keys, "_t", ["_end", "_o"], width)
    inside = F.when(F.col("_t") < F.col("_hit._end"), F.col("_hit._o"))
    return found.withColumn("owner", inside).drop("_hit", "_t")


def overlap_seconds(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, width: float | None = None) -> DataFrame:
    """Total length per key of the intersection of two sets of merged intervals, by a sweep:
    the stretch after an edge counts when both sets are open."""
    def edges(df: DataFrame, side: str) -> DataFrame:
        steps = df.select(*keys, F.explode(F.array(
            F.struct(F.col(start).alias("_at"), F.lit(1).alias("_d")), F.struct(F.col(end).alias("_at"), F.lit(-1).alias("_d"))
        )).alias("_x"))
        return steps.select(*keys, "_x._at", F.lit(0).alias("_l"), F.lit(0).alias("_r"), "_x._d").withColumn(side, F.col("_d")).drop("_d")

    moves = edges(left, "_l").unionByName(edges(right, "_r")).groupBy(*keys, "_at").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    chunk = S.range_chunk("_at", width or S.even_width(moves, keys, "_at"))
    swept = S.scan(
        moves, keys, ["_at"], chunk,
        _ol=S.total(F.col("_l")), _or=S.total(F.col("_r")), _to=S.following(F.col("_at")),
    )
    both = swept.where((F.col("_ol") > 0) & (F.col("_or") > 0))
    return both.groupBy(*keys).agg(F.sum(F.col("_to") - F.col("_at")).alias("overlap"))
