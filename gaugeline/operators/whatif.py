"""Single-pass load table over routed demands, and comparison of options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.names import link_key
from gaugeline.session import by_sort

EPS = 1e-9


def link_loads(flows: DataFrame, hops: DataFrame, capacity: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Offered load, utilisation and loss per directed link. Loads are summed per (a, b) with
    partial aggregation, so a trunk used by most flows does not collect them in one task. A link
    that is down (capacity 0) or has no capacity row has no utilisation and loses everything."""
    keys = keys or []
    used = flows.join(by_sort(hops), ["src", "dst"]).groupBy(*keys, "a", "b").agg(F.sum("mbps").alias("load"), F.count(F.lit(1)).alias("n_flows"))
    priced = used.withColumn("link", link_key(F.col("a"), F.col("b"))).join(by_sort(capacity), [*keys, "link"], "left")
    rho = F.when(F.col("capacity") > 0, F.col("load") / F.col("capacity"))
    return priced.withColumns({"rho": rho, "loss": F.when(rho.isNull(), 1.0).when(rho > 1 + EPS, 1 - 1 / rho).otherwise(0.0)})


def flow_outcomes(flows: DataFrame, hops: DataFrame, loads: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per flow the hottest hop (the first on a tie), delivered rate at that hop's share, and
    whether an elastic flow crosses a full link, where the load table does not hold. A flow without a
    route, or over a link that is down, delivers nothing and says why; a flow to its own node crosses
    no link and delivers everything."""
    keys = keys or []
    routed = flows.join(hops, ["src", "dst"], "left").join(loads.select(*keys, "a", "b", "rho", F.lit(True).alias("_priced")), [*keys, "a", "b"], "left")
    hop = F.concat_ws("->", "a", "b").alias("dlink")
    hottest = F.min(F.when(F.col("rho").isNotNull(), F.struct((-F.col("rho")).alias("neg"), F.col("hop"), hop)))
    down = F.min(F.when(F.col("a").isNotNull() & F.col("rho").isNull(), F.struct(F.col("hop"), hop)))
    per = routed.groupBy(*keys, "src", "dst", "mbps", "kind").agg(hottest.alias("_h"), down.alias("_d"), F.max(F.col("a").isNotNull()).alias("_routed"))
    top, home = -F.col("_h.neg"), F.col("src") == F.col("dst")
    reason = F.when(~F.col("_routed") & ~home, "no route").when(F.col("_d").isNotNull(), "link down")
    full = F.coalesce(top > 1 + EPS, F.lit(False))
    return per.select(
        *keys, "src", "dst", "mbps", "kind", top.alias("rho_max"),
        F.when(reason.isNotNull(), 0.0).otherwise(F.col("mbps") * F.least(F.lit(1.0), F.coalesce(1 / F.nullif(top, F.lit(0.0)), F.lit(1.0)))).alias("delivered"),
        F.when(F.col("_d").isNotNull(), F.col("_d.dlink")).when(full, F.col("_h.dlink")).alias("bottleneck"),
        ((F.col("kind") == "tcp") & full & reason.isNull()).alias("outside_validity"), reason.isNull().alias("reachable"), reason.alias("reason"),
    )


def override(capacity: DataFrame, options: DataFrame, overrides: DataFrame) -> DataFrame:
    """Capacity per option: the last override of a link wins, all else stays; 0 takes it down.
    ``options`` is the short list of scenarios."""
    last = overrides.groupBy("option", "link").agg(F.max_by("mbps", "seq").alias("_new"))
    return capacity.join(F.broadcast(options.select("option")), how="cross").join(last, ["option", "link"], "left").select(
        "option", "link", F.coalesce("_new", "capacity").alias("capacity")
    )


def optional_flows(flows: DataFrame, options: DataFrame, added: DataFrame) -> DataFrame:
    """The flows of every option: all of ``flows`` and the option's own ``added`` ones (option, src, dst,
    mbps, kind). ``options`` is the short list of scenarios."""
    names = options.agg(F.collect_list("option").alias("_o"))
    spread = flows.join(F.broadcast(names)).select(F.explode("_o").alias("option"), "src", "dst", "mbps", "kind")
    return spread.unionByName(added.select("option", "src", "dst", "mbps", "kind"))


def compare(outcomes: DataFrame, loads: DataFrame, base: str, loss: float = 0.05) -> DataFrame:
    """Each option against the base option, flow by flow; flows that the base lacks count from 0.
    ``hottest`` is the directed link with the highest utilisation, the first by name on a tie."""
    ref = outcomes.where(F.col("option") == base).select("src", "dst", "mbps", "kind", F.col("delivered").alias("_base"))
    delta = F.col("delivered") - F.coalesce("_base", F.lit(0.0))
    counted = outcomes.join(ref, ["src", "dst", "mbps", "kind"], "left").groupBy("option").agg(
        F.count(F.lit(1)).alias("n_flows"), F.sum(delta).alias("delta"), F.count_if(delta < -loss).alias("n_victims"),
        F.sum(F.col("mbps") - F.col("delivered")).alias("lost"), F.count_if("outside_validity").alias("n_outside"), F.count_if(~F.col("reachable")).alias("n_unreachable"),
    )
    hot = loads.where("rho is not null").groupBy("option").agg(F.min(F.struct((-F.col("rho")).alias("r"), "a", "b")).alias("_h"))
    return counted.join(hot, "option", "left").withColumn("hottest", F.concat_ws("->", "_h.a", "_h.b")).drop("_h")
