"""Names of links, entities and columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that decide what kind of column a name is.
META_SUFFIX = (".t_source",)
CUMULATIVE_SUFFIX = (".rxBytes", ".txBytes")
CONFIG_SUFFIX = (".bwMbps",)
BOOL_SUFFIX = (".qdiscValid", ".rateValid")
TEXT_SUFFIX = (".utilIntf", ".utilDirectionSource", ".lossSource", ".qdiscReason", ".rateReason", ".dump", ".state")
META_NAMES = ("run_id", "tick", "t_rel", "t_source", "timestamp", "profile", "seed", "group", "split", "fault", "fault_target")


def link_key(a: Column, b: Column, prefix: str = "") -> Column:
    """Same key for both directions."""
    return F.concat(F.lit(prefix), F.least(a, b), F.lit("-"), F.greatest(a, b))


def entity_of(column: Column) -> Column:
    """First part of a column name; aggregates belong to no entity."""
    return F.nullif(F.split_part(column, F.lit("."), F.lit(1)), F.lit("agg"))


def short_name(name: Column, sep: str = ":") -> Column:
    """What follows the first separator."""
    return F.regexp_replace(name, f"^[^{sep}]*{sep}", "")


def column_kind(name: Column) -> Column:
    ends = lambda suffixes: F.greatest(*[name.endswith(s) for s in suffixes], F.lit(False))
    return (
        F.when(name.isin(*META_NAMES) | ends(META_SUFFIX), "meta").when(ends(CUMULATIVE_SUFFIX), "cumulative")
        .when(ends(CONFIG_SUFFIX), "config").when(ends(BOOL_SUFFIX), "bool").when(ends(TEXT_SUFFIX), "text").otherwise("numeric")
    )


def worst_state(*states: Column) -> Column:
    """Heaviest of unknown < ok < warning < critical."""
    order = F.array(*[F.lit(s) for s in ("unknown", "ok", "warning", "critical")])
    return F.element_at(order, F.greatest(*[F.array_position(order, s) for s in states]).cast("int"))
