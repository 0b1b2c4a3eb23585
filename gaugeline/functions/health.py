"""Health class per entity; the heaviest finding wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeline.functions.names import worst_state

# Fixed limits: share of link capacity, host load in Mbps, path latency in ms and loss in percent.
LINK_WARN, LINK_CRIT = 0.70, 0.90
HOST_WARN, HOST_CRIT = 14.0, 18.0
LATENCY_WARN, LATENCY_CRIT = 50.0, 150.0
LOSS_WARN, LOSS_CRIT = 1.0, 5.0


def _level(value: Column, warn: float, crit: float) -> Column:
    return F.when(value > crit, "critical").when(value > warn, "warning").otherwise("ok")


def link_health(state: Column, rx: Column, tx: Column, capacity: Column) -> Column:
    """Rates and capacity in the same unit; the busier direction counts."""
    share = F.when(capacity > 0, F.greatest(rx, tx) / capacity)
    return F.when(state == "down", "critical").when(~state.eqNullSafe(F.lit("up")), "unknown").otherwise(_level(share, LINK_WARN, LINK_CRIT))


def host_health(state: Column, rx_mbps: Column, tx_mbps: Column) -> Column:
    return F.when(state == "down", "critical").when(state.isNull() | (state == "unknown"), "unknown").otherwise(
        _level(F.greatest(rx_mbps, tx_mbps), HOST_WARN, HOST_CRIT)
    )


def path_health(latency_ms: Column, loss_pct: Column) -> Column:
    found = worst_state(_level(latency_ms, LATENCY_WARN, LATENCY_CRIT), _level(loss_pct, LOSS_WARN, LOSS_CRIT))
    return F.when(latency_ms.isNull() & loss_pct.isNull(), "unknown").otherwise(found)
