"""Sets of entities as bitmaps: unions by one partial aggregation, containment by bit counts.

Entities are numbered in the order of their names, so those of one place mostly share a bucket. A set is
one row per bucket of 32 768 numbers it touches, and not one row per member. A is inside B if the
union of both has no more bits than B.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import scan as S
from gaugeline.session import cut_lineage

#: Levels of the dyadic cover of a time axis of whole ticks from 0.
LEVELS = 24


def numbered(entities: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """(keys, entity, number): places from 1 in name order inside a key, without one task for all."""
    dealt = entities.select(*keys, entity).distinct().repartitionByRange(*keys, entity).withColumn("_part", F.spark_partition_id().cast("bigint"))
    placed = S.row_index(cut_lineage(dealt), keys, [entity], F.col("_part"), "_i")
    return cut_lineage(placed.select(*keys, entity, (F.col("_i") + 1).alias("number")))


def bitmaps(members: DataFrame, keys: list[str], number: str = "number") -> DataFrame:
    """(keys, bucket, bits): the set of numbers of each key."""
    bucket = F.bitmap_bucket_number(F.col(number)).alias("bucket")
    return members.groupBy(*keys, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(number))).alias("bits"))


def contained(sets: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_members, n_inside) for each key of ``sets``; the set is inside its zone if both are equal.
    Both sides are (keys, bucket, bits); a key may have several zones, which count as their union."""
    both = sets.select(*keys, "bucket", F.col("bits").alias("_own"), F.lit(None).cast("binary").alias("_zone")).unionByName(
        zones.select(*keys, "bucket", F.lit(None).cast("binary").alias("_own"), F.col("bits").alias("_zone")))
    per = both.groupBy(*keys, "bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("_own")).alias("_n"), F.bitmap_count(F.bitmap_or_agg("_zone")).alias("_z"),
        F.bitmap_count(F.bitmap_or_agg(F.coalesce("_own", "_zone"))).alias("_all"))
    out = per.groupBy(*keys).agg(F.sum("_n").alias("n_members"), F.sum(F.col("_n") + F.col("_z") - F.col("_all")).alias("n_inside"))
    return out.where("n_members > 0")


def dyadic_cover(start: Column, end: Column) -> Column:
    """The fewest aligned spans of power-of-two length whose union is the ticks [start, end), as
    (level, node): at most two of each level. An end beyond the axis is its end."""
    top = F.lit(1 << LEVELS).cast("bigint")
    lo, hi = F.greatest(start.cast("bigint"), F.lit(0).cast("bigint")), F.least(end.cast("bigint"), top)

    def level(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        a, b = F.ceil(lo / width).cast("bigint"), F.floor(hi / width).cast("bigint")
        node = lambda n: F.struct(k.cast("int").alias("level"), n.alias("node"))
        return F.concat(
            F.when((a < b) & (a % 2 == 1), F.array(node(a))).otherwise(F.array()),
            F.when((a < b) & (b % 2 == 1), F.array(node(b - 1))).otherwise(F.array()))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), level))


def dyadic_path(at: Column, levels: list[int] | None = None) -> Column:
    """The aligned spans that hold a tick, one of each level or of each of ``levels``."""
    wanted = F.sequence(F.lit(0), F.lit(LEVELS)) if levels is None else F.array(*map(F.lit, levels)).cast("array<int>")
    return F.transform(wanted, lambda k: F.struct(k.cast("int").alias("level"), F.call_function("shiftright", at.cast("bigint"), k).alias("node")))


def active_zones(points: DataFrame, spans: DataFrame, zones: DataFrame, keys: list[str], at: str, start: str, end: str, target: str) -> DataFrame:
    """(keys, at, bucket, bits): for each point the union of the zones of the spans [start, end) that hold it.

    A span is cut into aligned pieces, the zones of all spans with one piece are OR-ed once, and a point
    reads the pieces above it, of the levels that there are: short spans have few. No point meets a span,
    however many overlap. ``zones`` is (target, bucket, bits)."""
    pieces = spans.select(*keys, target, F.explode(dyadic_cover(F.col(start), F.col(end))).alias("_p")).select(*keys, target, "_p.level", "_p.node").distinct()
    pieces = cut_lineage(pieces)
    levels = sorted(r["level"] for r in pieces.select("level").distinct().collect())  # 25 at most
    held = pieces.join(zones, target).groupBy(*keys, "level", "node", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    asked = points.select(*keys, at).distinct().select(*keys, at, F.explode(dyadic_path(F.col(at), levels)).alias("_p")).select(*keys, at, "_p.level", "_p.node")
    return asked.join(held, [*keys, "level", "node"]).groupBy(*keys, at, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
