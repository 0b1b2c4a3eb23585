"""Labels of published states, clocks and schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALARM = ("suspect", "act")


def view_label(fresh: Column, state: Column, cause: Column) -> Column:
    """Staleness is looked at before anything else: an expired message has no state."""
    blind = F.when(cause == "suppressed_intervention", "suppressed").otherwise("unknown")
    return (
        F.when(~fresh, "stale").when(cause == "stale_intervention", "stale_intervention").when(cause == "out_of_operating_range", "out_of_range")
        .when(state == "warming_up", "warming").when(state == "unknown", blind).when(state == "act", "act").otherwise("quiet")
    )


def timeline_category(published: Column, machine: Column, cause: Column, envelope: Column, act_rule: Column, residual: Column) -> Column:
    alarm = F.when(envelope | act_rule, "env_alarm").when(residual, "residual_only").otherwise("held")
    hidden = (published == "unknown") & (cause == "suppressed_intervention")
    return F.when(hidden, "suppressed").when(machine.isin(*ALARM), alarm).otherwise(published)


def severity(state: Column, stale: Column) -> Column:
    return (
        F.when(stale, "stale").when(state == "act", "critical").when(state == "suspect", "warning").when(state == "normal", "ok").otherwise("unknown")
    )


def alarm_channel(state: Column, fast: Column, slow: Column) -> Column:
    found = F.when(fast & slow, "fast+slow").when(fast, "fast").when(slow, "slow").otherwise("held")
    return F.when(state.isin(*ALARM), found).otherwise("")


def clock_offset(sent: str, received: str, remote: str, rtt: Column) -> Column:
    """Offset of the reading with the shortest round trip (an aggregate)."""
    return F.min_by((F.col(sent) + F.col(received)) / 2 - F.col(remote), rtt)


def level_at(schedule: Column, t: Column) -> Column:
    """Level of a stepwise schedule, an array of (start, level) by start."""
    return F.element_at(F.filter(schedule, lambda s: s["start"] <= t), -1)["level"]
