"""Routing, influence zones, load prediction and localisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import stats
from gaugeline.functions.names import link_key
from gaugeline.operators import bitmaps as B
from gaugeline.operators import intervals as I
from gaugeline.operators import quantiles as Q
from gaugeline.operators import routing as G
from gaugeline.operators import whatif as W
from gaugeline.plans import envelope as E
from gaugeline.plans import quality as PQ
from gaugeline.plans import views as V
from gaugeline.plans.registry import query, r6
from gaugeline.plans.views import SQL_VIEWS
from gaugeline.session import by_sort, cut_lineage

# Suppliers are hosts on the switch of their nation; the lowest nation of a region is its core
# switch. Demands run from the customer's switch to the supplier. Core switches of other regions do
# not know every 25th host, so some demands have no route.
SQL_VIEWS["sw"] = "SELECT n_nationkey AS n, n_regionkey AS r, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS head FROM nation"
SQL_VIEWS["nh"] = """SELECT 's' || s.n AS node, 'h' || p.s_suppkey AS dst, CASE WHEN s.n = d.n THEN 'h' || p.s_suppkey WHEN s.r = d.r THEN 's' || d.n
  WHEN s.n = s.head THEN 's' || d.head ELSE 's' || s.head END AS next FROM sw s CROSS JOIN supplier p JOIN sw d ON d.n = p.s_nationkey
  WHERE NOT (s.r <> d.r AND s.n = s.head AND p.s_suppkey % 25 = 3)"""
SQL_VIEWS["demand"] = """SELECT 's' || c_nationkey AS src, 'h' || l_suppkey AS dst, round(sum(l_quantity) / 100.0, 4) AS mbps, CASE WHEN count(*) % 2 = 0 THEN 'tcp' ELSE 'udp' END AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
SQL_VIEWS["hop0"] = """SELECT src, demand.dst, 0 AS hop, src AS a, next AS b FROM demand JOIN nh ON nh.node = src AND nh.dst = demand.dst
  UNION ALL SELECT h.src, h.dst, h.hop + 1 AS hop, h.b AS a, nh.next AS b FROM hop0 h JOIN nh ON nh.node = h.b AND nh.dst = h.dst WHERE h.b <> h.dst"""
SQL_VIEWS["hop"] = "SELECT * FROM hop0 SEMI JOIN (SELECT src, dst FROM hop0 WHERE b = dst) USING (src, dst)"
SQL_VIEWS["hopl"] = "SELECT *, least(a, b) || '-' || greatest(a, b) AS link FROM hop"
SQL_VIEWS["caps_l"] = "SELECT link, 20.3 + (CAST(substr(any_value(a), 2) AS BIGINT) + CAST(substr(any_value(b), 2) AS BIGINT)) % 60 AS capacity FROM hopl GROUP BY link"
SQL_VIEWS["dload"] = """SELECT a, b, any_value(link) AS link, sum(mbps) AS load, count(*) AS n_flows, any_value(capacity) AS capacity, sum(mbps) / any_value(capacity) AS rho
  FROM demand JOIN hopl USING (src, dst) JOIN caps_l USING (link) GROUP BY a, b"""


def switches(spark, sf):
    n = V.table(spark, sf, "nation")
    head = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("head"))
    return n.join(head, "n_regionkey").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"), "head")


def tag(letter, column):
    return F.concat(F.lit(letter), column.cast("string"))


def next_hops(spark, sf):
    s = switches(spark, sf)
    d = s.select(F.col("n").alias("dn"), F.col("r").alias("dr"), F.col("head").alias("dhead"))
    hosts = V.table(spark, sf, "supplier").join(d, F.col("s_nationkey") == F.col("dn"))
    nodes = F.collect_list(F.struct("n", "r", "head"))
    # A routing table has one row per (switch, host): the short switch list is spread over the hosts.
    rows = hosts.join(F.broadcast(s.agg(nodes.alias("_s")))).select("*", F.explode("_s").alias("s"))
    nxt = (
        F.when(F.col("s.n") == F.col("dn"), tag("h", F.col("s_suppkey"))).when(F.col("s.r") == F.col("dr"), tag("s", F.col("dn")))
        .when(F.col("s.n") == F.col("s.head"), tag("s", F.col("dhead"))).otherwise(tag("s", F.col("s.head")))
    )
    unknown = (F.col("s.r") != F.col("dr")) & (F.col("s.n") == F.col("s.head")) & (F.col("s_suppkey") % 25 == 3)
    return rows.where(~unknown).select(tag("s", F.col("s.n")).alias("node"), tag("h", F.col("s_suppkey")).alias("dst"), nxt.alias("next"))


def demands(spark, sf):
    items, orders, cust = (V.table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    src = orders.join(by_sort(cust), orders.o_custkey == cust.c_custkey).select("o_orderkey", "c_nationkey")
    rows = items.join(by_sort(src), items.l_orderkey == src.o_orderkey)
    kind = F.when(F.count(F.lit(1)) % 2 == 0, "tcp").otherwise("udp")
    # keys become names after the sums: once a pair and not once an item
    pairs = rows.groupBy("c_nationkey", "l_suppkey").agg(F.round(F.sum("l_quantity") / 100.0, 4).alias("mbps"), kind.alias("kind"))
    return pairs.select(tag("s", F.col("c_nationkey")).alias("src"), tag("h", F.col("l_suppkey")).alias("dst"), "mbps", "kind")


def routed(spark, sf):
    flows = cut_lineage(demands(spark, sf))
    hops, _ = G.expand(flows, next_hops(spark, sf))
    return flows, hops


def capacities(hops):
    number = lambda c: F.substring(c, 2, 12).cast("bigint")
    links = hops.select(link_key(F.col("a"), F.col("b")).alias("link"), (number(F.col("a")) + number(F.col("b"))).alias("s")).distinct()
    return links.select("link", (20.3 + F.col("s") % 60).alias("capacity"))


@query("route_paths", "GR1", "SELECT src, dst, count(*) AS n_hops, string_agg(b, '>' ORDER BY hop) AS via FROM hop GROUP BY src, dst")
def route_paths(spark, sf):
    _, hops = routed(spark, sf)
    return G.path_arrays(hops).withColumn("via", F.array_join("via", ">"))


@query("flows_through_links", "GR2", f"SELECT link, count(*) AS n_flows, {r6('sum(mbps)')} AS mbps FROM (SELECT DISTINCT src, dst, link FROM hopl) JOIN demand USING (src, dst) GROUP BY link")
def flows_through_links(spark, sf):
    flows, hops = routed(spark, sf)
    used = hops.select("src", "dst", link_key(F.col("a"), F.col("b")).alias("link")).distinct()
    return used.join(flows, ["src", "dst"]).groupBy("link").agg(F.count(F.lit(1)).alias("n_flows"), F.sum("mbps").alias("mbps"))


# Switches in the radius of a link: on a route that shares it, or on its detour.
SQL_VIEWS["edge_z"] = "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM hop WHERE b LIKE 's%'"
SQL_VIEWS["step_z"] = "SELECT a, b FROM edge_z UNION SELECT b, a FROM edge_z"
SQL_VIEWS["walk_z"] = """SELECT e.a, e.b, e.a AS node, [e.a] AS path FROM edge_z e
  UNION ALL SELECT w.a, w.b, u.b AS node, list_append(w.path, u.b) AS path FROM walk_z w JOIN step_z u ON u.a = w.node WHERE NOT list_contains(w.path, u.b) AND w.node <> w.b AND NOT (u.a = w.a AND u.b = w.b)"""
SQL_VIEWS["detour_z"] = "SELECT a || '-' || b AS link, path FROM walk_z WHERE node = b QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY len(path), path) = 1"
SQL_VIEWS["heavy_z"] = "SELECT * FROM hopl SEMI JOIN (SELECT src, dst FROM demand WHERE mbps > (SELECT avg(mbps) FROM demand)) USING (src, dst)"
SQL_VIEWS["zone_z"] = """SELECT DISTINCT t.link AS target, unnest([h.a, h.b]) AS entity FROM (SELECT DISTINCT src, dst, link FROM heavy_z) t JOIN heavy_z h USING (src, dst)
  UNION SELECT link AS target, unnest(path) AS entity FROM detour_z"""
# A device is on a switch; a reading above 60 violates there. An intervention acts on a host's access
# link or on the link of the device's switch to its core switch; a host that nobody knows has no zone.
SQL_VIEWS["viol_z"] = "SELECT DISTINCT run_id, g, tick, 's' || CAST(user_id % 25 AS VARCHAR) AS entity FROM ev WHERE value > 60"
SQL_VIEWS["acts_z"] = """SELECT e.run_id, e.event_id AS iid, e.us, e.tick AS s, CASE e.k % 3 WHEN 0 THEN e.tick + 2 WHEN 1 THEN e.tick + 4 ELSE e.tick + 6 END AS e,
  CASE WHEN e.k % 4 < 3 THEN 'h' || CAST(e.k AS VARCHAR) || '-s' || CAST(p.s_nationkey AS VARCHAR)
    ELSE least('s' || CAST(sw.n AS VARCHAR), 's' || CAST(sw.head AS VARCHAR)) || '-' || greatest('s' || CAST(sw.n AS VARCHAR), 's' || CAST(sw.head AS VARCHAR)) END AS target
  FROM ev e LEFT JOIN supplier p ON p.s_suppkey = e.k JOIN sw ON sw.n = e.user_id % 25 WHERE e.event_id % 20 = 5"""


@query("influence_zones", "GR3 GR5", f"""
WITH t AS (SELECT DISTINCT src, dst, link FROM hopl), z AS (SELECT DISTINCT t.link, h.link AS entity, 'link' AS kind FROM t JOIN hopl h USING (src, dst)
 UNION SELECT DISTINCT t.link, unnest([h.a, h.b]) AS entity, 'node' AS kind FROM t JOIN hopl h USING (src, dst))
SELECT link, count(*) FILTER (WHERE kind = 'link') AS n_links, count(*) FILTER (WHERE kind = 'node') AS n_nodes, min(entity) AS first_entity, {r6("count(*) FILTER (WHERE kind = 'link') / (SELECT count(DISTINCT link) FROM hopl)")} AS local_share FROM z GROUP BY link""")
def influence_zones(spark, sf):
    _, hops = routed(spark, sf)
    hops = cut_lineage(hops)
    numbers = B.numbered(G.elements(hops).select("kind", "entity"), ["kind"], "entity")
    total = F.broadcast(numbers.where("kind = 'link'").agg(F.count(F.lit(1)).alias("n_all")))  # one row
    size = F.bitmap_count("bits")
    per = G.zones(hops, numbers).groupBy("link").agg(
        F.sum(F.when(F.col("kind") == "link", size)).alias("n_links"), F.sum(F.when(F.col("kind") == "node", size)).alias("n_nodes"), F.min("first_entity").alias("first_entity")
    )
    return per.join(total).select("link", "n_links", "n_nodes", "first_entity", (F.col("n_links") / F.col("n_all")).alias("local_share"))


@query("detour_paths", "GR4", """
WITH e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM hop WHERE b LIKE 's%'), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w AS (SELECT e.a, e.b, e.a AS node, [e.a] AS path FROM e
 UNION ALL SELECT w.a, w.b, u.b AS node, list_append(w.path, u.b) AS path FROM w JOIN u ON u.a = w.node WHERE NOT list_contains(w.path, u.b) AND w.node <> w.b AND NOT (u.a = w.a AND u.b = w.b))
SELECT a, b, array_to_string(path, '>') AS path FROM w WHERE node = b QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY len(path), path) = 1""")
def detour_paths(spark, sf):
    _, hops = routed(spark, sf)
    edges = hops.where(F.col("b").startswith("s")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return G.detours(edges, edges).withColumn("path", F.array_join("path", ">"))


@query("radius_with_detour", "GR4", f"""
WITH e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM hop WHERE b LIKE 's%'), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w AS (SELECT e.a, e.b, e.a AS node, [e.a] AS path FROM e
 UNION ALL SELECT w.a, w.b, u.b AS node, list_append(w.path, u.b) AS path FROM w JOIN u ON u.a = w.node WHERE NOT list_contains(w.path, u.b) AND w.node <> w.b AND NOT (u.a = w.a AND u.b = w.b)),
d AS (SELECT a || '-' || b AS link, path FROM w WHERE node = b QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY len(path), path) = 1),
i AS (SELECT link, path, unnest(range(1, len(path))) AS i FROM d), k AS (SELECT link, unnest(path) AS entity FROM d UNION SELECT link, least(path[i], path[i + 1]) || '-' || greatest(path[i], path[i + 1]) FROM i),
t AS (SELECT DISTINCT src, dst, link FROM hopl), z AS (SELECT DISTINCT t.link, h.link AS entity FROM t JOIN hopl h USING (src, dst) UNION SELECT DISTINCT t.link, unnest([h.a, h.b]) FROM t JOIN hopl h USING (src, dst)),
x AS (SELECT coalesce(z.link, k.link) AS link, z.link IS NOT NULL AS r, k.link IS NOT NULL AS c FROM z FULL JOIN k ON z.link = k.link AND z.entity = k.entity)
SELECT link, count(*) FILTER (WHERE r) AS n_radius, count(*) FILTER (WHERE c) AS n_corridor, count(*) AS n_all FROM x WHERE link NOT LIKE 'h%' GROUP BY link""")
def radius_with_detour(spark, sf):
    """The radius of each trunk link: all on a path that shares it, and the corridor of its detour."""
    radius, corridor = link_zones(spark, sf)
    trunk = radius.where("link not like 'h%'")
    rows = trunk.select("link", "kind", "bucket", "bits", F.lit("r").alias("part")).unionByName(corridor.withColumn("part", F.lit("c")))
    bits = lambda part: F.coalesce(F.bitmap_count(F.bitmap_or_agg(F.when(F.col("part") == part, F.col("bits")))), F.lit(0))
    per = rows.groupBy("link", "kind", "bucket").agg(bits("r").alias("r"), bits("c").alias("c"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    return per.groupBy("link").agg(F.sum("r").alias("n_radius"), F.sum("c").alias("n_corridor"), F.sum("n").alias("n_all"))


def link_zones(spark, sf):
    """Bitmaps of the radius of every link, and of the detour corridor of every trunk link."""
    _, hops = routed(spark, sf)
    hops = cut_lineage(hops)
    edges = hops.where(F.col("b").startswith("s")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    path = F.col("path")
    steps = F.zip_with(F.slice(path, F.lit(1), F.size(path) - 1), F.slice(path, F.lit(2), F.size(path) - 1), lambda x, y: link_key(x, y))
    kinds = F.concat(F.transform(path, lambda e: F.struct(F.lit("node").alias("kind"), e.alias("entity"))), F.transform(steps, lambda e: F.struct(F.lit("link").alias("kind"), e.alias("entity"))))
    corridor = cut_lineage(G.detours(edges, edges).select(link_key(F.col("a"), F.col("b")).alias("link"), F.explode(kinds).alias("_x")).select("link", "_x.*"))
    numbers = B.numbered(G.elements(hops).select("kind", "entity").unionByName(corridor.select("kind", "entity")), ["kind"], "entity")
    return G.zones(hops, numbers).drop("first_entity"), B.bitmaps(corridor.join(numbers, ["kind", "entity"]), ["link", "kind"])


def switch_zones(spark, sf):
    """(target, bucket, bits) of the switches in the radius and corridor of every link, over the routes of
    flows above the mean, and their numbers."""
    flows, hops = routed(spark, sf)
    hops = cut_lineage(hops)
    edges = hops.where(F.col("b").startswith("s")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    corridor = G.detours(edges, edges).select(link_key(F.col("a"), F.col("b")).alias("target"), F.explode("path").alias("entity"))
    nodes = switches(spark, sf).select(F.lit("node").alias("kind"), tag("s", F.col("n")).alias("entity"))
    numbers = B.numbered(nodes, ["kind"], "entity")
    mean = F.broadcast(flows.agg(F.avg("mbps").alias("mean")))  # one row
    heavy = flows.join(mean).where(F.col("mbps") > F.col("mean")).select("src", "dst")
    switch = lambda e: (e["kind"] == "node") & e["entity"].startswith("s")
    radius = G.zones(hops.join(heavy, ["src", "dst"], "left_semi"), numbers, keep=switch).select(F.col("link").alias("target"), "bucket", "bits")
    both = radius.unionByName(B.bitmaps(corridor.join(numbers, "entity"), ["target"]))
    return cut_lineage(both.groupBy("target", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))), numbers.select("entity", "number")


def violating_switches(spark, sf):
    return V.ev(spark, sf).where("value > 60").select("run_id", "tick", tag("s", F.col("user_id") % 25).alias("entity")).distinct()


def link_acts(spark, sf):
    """(run_id, iid, us, s, e, target) of the interventions on links."""
    hosts = V.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"), tag("s", F.col("s_nationkey")).alias("at"))
    home = switches(spark, sf).select(F.col("n").cast("bigint").alias("n"), tag("s", F.col("n")).alias("own"), tag("s", F.col("head")).alias("core"))
    event = V.ev(spark, sf).where("event_id % 20 = 5").withColumn("n", F.col("user_id") % 25).join(hosts, "k", "left").join(home, "n")
    target = F.when(F.col("k") % 4 < 3, link_key(tag("h", F.col("k")), F.col("at"))).otherwise(link_key(F.col("own"), F.col("core")))
    kind = F.when(F.col("k") % 3 == 0, "transient").otherwise("lasting")
    end = I.active_until(kind, F.col("tick"), F.when(F.col("k") % 3 == 1, F.col("tick") + 2), 2.0, 6.0)
    return event.select("run_id", F.col("event_id").alias("iid"), "us", F.col("tick").alias("s"), end.cast("bigint").alias("e"), target.alias("target"))


@query("routing_loops", "GR6", """
WITH bad AS (SELECT node, dst, CASE WHEN CAST(substr(dst, 2) AS BIGINT) % 10 = 7 AND next LIKE 's%' AND node IN (SELECT 's' || head FROM sw) THEN CASE WHEN node = 's0' THEN 's1' ELSE 's0' END ELSE next END AS next FROM nh),
x AS (SELECT node AS src, dst, node AS pos, 0 AS i FROM bad UNION ALL SELECT x.src, x.dst, b.next AS pos, i + 1 AS i FROM x JOIN bad b ON b.node = x.pos AND b.dst = x.dst WHERE x.pos <> x.dst AND i <= (SELECT count(*) FROM sw))
SELECT dst, count(*) AS n_unfinished FROM x WHERE i > (SELECT count(*) FROM sw) AND pos <> dst GROUP BY dst""")
def routing_loops(spark, sf):
    table = next_hops(spark, sf)
    heads = switches(spark, sf).select(tag("s", F.col("head")).alias("node")).distinct().withColumn("core", F.lit(True))
    odd = F.substring("dst", 2, 12).cast("bigint") % 10 == 7
    wrong = F.when(F.col("node") == "s0", "s1").otherwise("s0")
    bad = table.join(heads, "node", "left").select(
        "node", "dst", F.when(odd & F.col("next").startswith("s") & F.coalesce("core", F.lit(False)), wrong).otherwise(F.col("next")).alias("next")
    )
    return G.resolve(bad).where(F.col("status") == G.LOOP).groupBy("dst").agg(F.count(F.lit(1)).alias("n_unfinished"))


@query("link_loads", "AG44 PRJ11", f"SELECT a, b, link, {r6('load')} AS load, n_flows, {r6('capacity')} AS capacity, {r6('rho')} AS rho, {r6('CASE WHEN rho > 1 + 1e-9 THEN 1 - 1 / rho ELSE 0.0 END')} AS loss FROM dload")
def link_loads(spark, sf):
    flows, hops = routed(spark, sf)
    return W.link_loads(flows, hops, capacities(hops))


OUTCOME = """o AS (SELECT src, dst, mbps, kind, max(rho) AS rho_max, arg_min(a || '->' || b, (-rho, hop)) AS dlink, bool_or(a IS NOT NULL) AS routed
  FROM demand LEFT JOIN hop USING (src, dst) LEFT JOIN dload USING (a, b) GROUP BY ALL)"""


@query("flow_outcomes", "AG44 SRT7", f"""WITH {OUTCOME}
SELECT src, dst, {r6('mbps')} AS mbps, kind, {r6('rho_max')} AS rho_max, {r6('CASE WHEN routed THEN mbps * least(1.0, 1 / rho_max) ELSE 0.0 END')} AS delivered, CASE WHEN rho_max > 1 + 1e-9 THEN dlink END AS bottleneck,
 kind = 'tcp' AND coalesce(rho_max > 1 + 1e-9, false) AS outside_validity, routed AS reachable, CASE WHEN NOT routed THEN 'no route' END AS reason FROM o""")
def flow_outcomes(spark, sf):
    flows, hops = routed(spark, sf)
    return W.flow_outcomes(flows, hops, W.link_loads(flows, hops, capacities(hops)))


# Options: the core switch of a region is slowed or taken down and brought back slower; a demand is added.
SQL_VIEWS["opts"] = """SELECT 'base' AS option, -1 AS head UNION ALL SELECT DISTINCT 'cut-' || r, head FROM sw UNION ALL SELECT DISTINCT 'down-' || r, head FROM sw WHERE r < 2
  UNION ALL SELECT DISTINCT 'back-' || r, head FROM sw WHERE r = 1 UNION ALL SELECT 'more', -1"""
SQL_VIEWS["caps_o"] = """SELECT option, link, CASE WHEN head >= 0 AND (split_part(link, '-', 1) = 's' || head OR split_part(link, '-', 2) = 's' || head) AND link NOT LIKE 'h%'
  THEN CASE split_part(option, '-', 1) WHEN 'down' THEN 0.0 WHEN 'back' THEN 15.0 ELSE 10.0 END ELSE capacity END AS capacity FROM opts CROSS JOIN caps_l"""
SQL_VIEWS["demand_o"] = """SELECT option, src, dst, mbps, kind FROM opts CROSS JOIN demand UNION ALL SELECT 'more', src, dst, 12.5, 'udp' FROM demand WHERE CAST(substr(dst, 2) AS BIGINT) % 10 = 1"""
SQL_VIEWS["load_o"] = """SELECT option, a, b, any_value(link) AS link, CASE WHEN any_value(capacity) > 0 THEN sum(mbps) / any_value(capacity) END AS rho FROM demand_o JOIN hopl USING (src, dst) JOIN caps_o USING (option, link) GROUP BY option, a, b"""
SQL_VIEWS["out_o"] = """SELECT option, src, dst, mbps, kind, max(rho) AS rho_max, bool_or(a IS NOT NULL) AND NOT bool_or(a IS NOT NULL AND rho IS NULL) AS reachable,
  CASE WHEN bool_or(a IS NOT NULL) AND NOT bool_or(a IS NOT NULL AND rho IS NULL) THEN mbps * least(1.0, 1 / max(rho)) ELSE 0.0 END AS delivered
  FROM demand_o LEFT JOIN hop USING (src, dst) LEFT JOIN load_o USING (option, a, b) GROUP BY option, src, dst, mbps, kind"""


def option_tables(spark, sf):
    flows, hops = routed(spark, sf)
    caps = cut_lineage(capacities(hops))
    heads = switches(spark, sf).select("r", "head").distinct()
    name = lambda kind: F.concat(F.lit(f"{kind}-"), F.col("r").cast("string")).alias("option")
    # (option, core switch, order, capacity): the last one of a link counts
    steps = heads.select(name("cut"), "head", F.lit(1).alias("seq"), F.lit(10.0).alias("mbps")).unionByName(
        heads.where("r < 2").select(name("down"), "head", F.lit(1).alias("seq"), F.lit(0.0).alias("mbps"))).unionByName(
        heads.where("r = 1").select(name("back"), "head", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit(0.0).alias("mbps")), F.struct(F.lit(2).alias("seq"), F.lit(15.0).alias("mbps")))).alias("_s")).select("option", "head", "_s.*"))
    options = steps.select("option").distinct().unionByName(spark.createDataFrame([("base",), ("more",)], "option string"))
    ends = [F.split_part("link", F.lit("-"), F.lit(i)) for i in (1, 2)]
    trunk = caps.where(~F.col("link").startswith("h")).select("link", F.explode(F.array(*ends)).alias("hd"))
    changed = trunk.join(steps.withColumn("hd", tag("s", F.col("head"))), "hd").select("option", "link", "mbps", "seq").distinct()
    added = flows.where(F.substring("dst", 2, 12).cast("bigint") % 10 == 1).select(F.lit("more").alias("option"), "src", "dst", F.lit(12.5).alias("mbps"), F.lit("udp").alias("kind"))
    return W.optional_flows(flows, options, added), hops, W.override(caps, options, changed)


@query("option_comparison", "AG45 JN21", f"""
WITH h AS (SELECT option, arg_min(a || '->' || b, (-rho, a, b)) AS hottest FROM load_o WHERE rho IS NOT NULL GROUP BY option)
SELECT o.option, count(*) AS n_flows, {r6('sum(o.delivered - coalesce(b.delivered, 0))')} AS delta, count(*) FILTER (WHERE o.delivered - coalesce(b.delivered, 0) < -0.05) AS n_victims, {r6('sum(o.mbps - o.delivered)')} AS lost,
 count(*) FILTER (WHERE o.kind = 'tcp' AND o.rho_max > 1 + 1e-9 AND o.reachable) AS n_outside, count(*) FILTER (WHERE NOT o.reachable) AS n_unreachable, any_value(hottest) AS hottest
FROM out_o o LEFT JOIN out_o b ON b.option = 'base' AND b.src = o.src AND b.dst = o.dst AND b.mbps = o.mbps AND b.kind = o.kind LEFT JOIN h ON h.option = o.option GROUP BY o.option""")
def option_comparison(spark, sf):
    flows, hops, caps = option_tables(spark, sf)
    loads = cut_lineage(W.link_loads(flows, hops, caps, ["option"]))
    return W.compare(W.flow_outcomes(flows, hops, loads, ["option"]), loads, "base")


@query("hot_links", "SRT6", f"""
SELECT option, rank, a, b, {r6('rho')} AS rho FROM (SELECT *, row_number() OVER (PARTITION BY option ORDER BY rho DESC, a, b) AS rank FROM load_o WHERE rho >= 0.9) WHERE rank <= 3""")
def hot_links(spark, sf):
    from gaugeline.operators.ranking import top_per_key

    flows, hops, caps = option_tables(spark, sf)
    loads = W.link_loads(flows, hops, caps, ["option"]).where("rho >= 0.9")
    return top_per_key(loads, ["option"], "rho", ["a", "b"], 3).select("option", "rank", "a", "b", "rho")


@query("link_loss_percent", "AG46", f"SELECT link, {r6('sum(greatest(load - capacity, 0.0)) / sum(load) * 100')} AS loss_pct FROM dload GROUP BY link")
def link_loss_percent(spark, sf):
    flows, hops = routed(spark, sf)
    over = F.sum(F.greatest(F.col("load") - F.col("capacity"), F.lit(0.0)))
    return W.link_loads(flows, hops, capacities(hops)).groupBy("link").agg((over / F.sum("load") * 100).alias("loss_pct"))


SQL_VIEWS["meas"] = """SELECT a, b, sum(m) AS meas FROM (SELECT 's' || c_nationkey AS src, 'h' || l_suppkey AS dst, sum(l_quantity * (1 - l_discount)) / 100.0 AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL) JOIN hop USING (src, dst) GROUP BY a, b"""
SQL_VIEWS["errs"] = """SELECT coalesce(d.a, m.a) AS a, coalesce(d.b, m.b) AS b, coalesce(least(load, capacity), 0.0) AS pred, coalesce(meas, 0.0) AS meas, CASE WHEN d.rho > 1 THEN 'outside' ELSE 'inside' END AS zone
  FROM dload d FULL JOIN meas m ON m.a = d.a AND m.b = d.b WHERE greatest(coalesce(least(load, capacity), 0.0), coalesce(meas, 0.0)) >= 0.5"""


def prediction_errors(spark, sf):
    flows, hops = routed(spark, sf)
    pred = W.link_loads(flows, hops, capacities(hops)).select("a", "b", F.least("load", "capacity").alias("pred"), "rho")
    items, orders, cust = (V.table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    src = orders.join(cust.where("c_mktsegment <> 'BUILDING'"), orders.o_custkey == cust.c_custkey).select("o_orderkey", "c_nationkey")
    seen = items.join(by_sort(src), items.l_orderkey == src.o_orderkey).groupBy(tag("s", F.col("c_nationkey")).alias("src"), tag("h", F.col("l_suppkey")).alias("dst")).agg(
        (F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))) / 100.0).alias("m")
    )
    meas = seen.join(hops, ["src", "dst"]).groupBy("a", "b").agg(F.sum("m").alias("meas"))
    both = pred.join(meas, ["a", "b"], "full_outer")
    zero = F.lit(0.0)
    out = both.select("a", "b", F.coalesce("pred", zero).alias("pred"), F.coalesce("meas", zero).alias("meas"), F.when(F.col("rho") > 1, "outside").otherwise("inside").alias("zone"))
    return out.where(F.greatest("pred", "meas") >= 0.5)


@query("prediction_check", "JN15", f"SELECT a, b, {r6('pred')} AS pred, {r6('meas')} AS meas, {r6('pred - meas')} AS err, zone FROM errs")
def prediction_check(spark, sf):
    return prediction_errors(spark, sf).select("a", "b", "pred", "meas", (F.col("pred") - F.col("meas")).alias("err"), "zone")


@query("prediction_summary", "AG43", f"""
SELECT zone, count(*) AS n, {r6('median(abs(pred - meas))')} AS median_abs, {r6('max(abs(pred - meas))')} AS max_abs, {r6('median(abs(pred - meas) / greatest(meas, 0.5))')} AS median_rel, {r6('avg(CASE WHEN abs(pred - meas) / greatest(meas, 0.5) <= 0.10 THEN 1.0 ELSE 0.0 END)')} AS share_close FROM errs GROUP BY zone""")
def prediction_summary(spark, sf):
    gap = F.abs(F.col("pred") - F.col("meas"))
    rows = cut_lineage(prediction_errors(spark, sf).select("zone", gap.alias("gap"), (gap / F.greatest("meas", F.lit(0.5))).alias("rel")))
    per = rows.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("max_abs"), F.avg((F.col("rel") <= 0.10).cast("double")).alias("share_close"))
    for name, column in (("median_abs", "gap"), ("median_rel", "rel")):
        per = per.join(Q.quantiles(rows, ["zone"], column, {name: ("middle", 0.5)}), "zone")
    return per


@query("window_means", "AG42 PRJ12 FN16", f"""
WITH d AS (SELECT run_id, entity, avg(v) FILTER (WHERE tick BETWEEN 2 AND 18) * 8e-3 AS pre, avg(v) FILTER (WHERE tick BETWEEN 25 AND 38) * 8e-3 AS post, count(v) AS n FROM lab GROUP BY run_id, entity)
SELECT run_id, CASE WHEN entity IN ('link-click', 'link-error') THEN 'core->' || substr(entity, 6) ELSE substr(entity, 6) || '->core' END AS dlink, CASE WHEN entity IN ('link-click', 'link-error') THEN 'directed_map' ELSE 'alphabetical_fallback' END AS source,
 {r6('pre')} AS pre_mbps, {r6('post')} AS post_mbps, n FROM d""")
def window_means(spark, sf):
    # Fixed direction map of the view: links measured at the core end.
    known = F.create_map(*[F.lit(x) for x in ("link-click", "core", "link-error", "core")])
    owner = F.coalesce(known[F.col("entity")], F.substring("entity", 6, 99))
    other = F.when(owner == "core", F.substring("entity", 6, 99)).otherwise("core")
    per = PQ.labelled(spark, sf).groupBy("run_id", "entity").agg(
        (F.avg(F.when(F.col("tick").between(2, 18), F.col("v"))) * 8e-3).alias("pre_mbps"), (F.avg(F.when(F.col("tick").between(25, 38), F.col("v"))) * 8e-3).alias("post_mbps"), F.count("v").alias("n")
    )
    return per.select("run_id", F.concat_ws("->", owner, other).alias("dlink"), F.when(known[F.col("entity")].isNotNull(), "directed_map").otherwise("alphabetical_fallback").alias("source"), "pre_mbps", "post_mbps", "n")


@query("blind_scores", "JN16", f"""
WITH p AS (SELECT entity, round(avg(v), 2) AS pred FROM lab WHERE split = 'train' GROUP BY entity), m AS (SELECT run_id, entity, avg(v) AS meas FROM lab WHERE split = 'test' AND tick BETWEEN 25 AND 38 GROUP BY run_id, entity)
SELECT run_id, entity, {r6('pred')} AS pred, {r6('meas')} AS meas, CASE WHEN meas IS NULL THEN 'NO_DATA' WHEN abs(pred - meas) <= greatest(5.0, 0.15 * abs(pred)) THEN 'MET' ELSE 'MISSED' END AS verdict FROM m JOIN p USING (entity)""")
def blind_scores(spark, sf):
    rows = PQ.labelled(spark, sf)
    pred = rows.where("split = 'train'").groupBy("entity").agg(F.round(F.avg("v"), 2).alias("pred"))
    meas = rows.where("split = 'test' and tick between 25 and 38").groupBy("run_id", "entity").agg(F.avg("v").alias("meas"))
    met = F.abs(F.col("pred") - F.col("meas")) <= F.greatest(F.lit(5.0), 0.15 * F.abs(F.col("pred")))
    return meas.join(pred, "entity").select("run_id", "entity", "pred", "meas", F.when(F.col("meas").isNull(), "NO_DATA").when(met, "MET").otherwise("MISSED").alias("verdict"))


@query("model_inputs", "JN20 PRJ23", f"""
WITH last AS (SELECT run_id, entity, arg_max(rate, tick) AS rate, arg_max(ok, tick) AS ok, max(tick) AS tick FROM cells GROUP BY run_id, entity), grid AS (SELECT run_id, n_ticks, e AS entity FROM runs CROSS JOIN (SELECT DISTINCT entity AS e FROM cells) UNION ALL SELECT run_id, n_ticks, 'link-backup' FROM runs)
SELECT run_id, entity, {r6('CASE WHEN ok AND n_ticks - 1 - tick <= 0 THEN rate ELSE 100.0 END')} AS mbps, concat_ws(',', CASE WHEN tick IS NULL THEN 'missing' END, CASE WHEN n_ticks - 1 - tick > 0 THEN 'stale' END, CASE WHEN NOT ok THEN 'invalid' END) AS warnings
FROM grid LEFT JOIN last USING (run_id, entity)""")
def model_inputs(spark, sf):
    cells = V.cells(spark, sf)
    last = cells.groupBy("run_id", "entity").agg(F.max_by("rate", "tick").alias("rate"), F.max_by("ok", "tick").alias("ok"), F.max("tick").alias("tick"))
    expected = F.explode(F.array(*[F.lit(e) for e in (*V.ENTITIES, "link-backup")])).alias("entity")
    grid = V.runs(spark, sf).select("run_id", "n_ticks", expected)
    both = grid.join(last, ["run_id", "entity"], "left")
    age = F.col("n_ticks") - 1 - F.col("tick")
    notes = F.array(F.when(F.col("tick").isNull(), "missing"), F.when(age > 0, "stale"), F.when(~F.col("ok"), "invalid"))
    return both.select("run_id", "entity", F.coalesce(F.when(F.col("ok") & (age <= 0), F.col("rate")), F.lit(100.0)).alias("mbps"), F.array_join(F.filter(notes, lambda x: x.isNotNull()), ",").alias("warnings"))


@query("first_loss", "AG65 FN6", f"""
WITH f AS (SELECT run_id, entity, min(tick) AS t1 FROM lab WHERE grp = 'F' AND tick > inject AND v > 200 GROUP BY run_id, entity)
SELECT run_id, entity, t1 AS first_tick, {r6('avg(v)')} AS mean_after, {r6('12096000.0 / (avg(v) * 1e6 - 100.0 * 1e6)')} AS fill_s FROM lab JOIN f USING (run_id, entity) WHERE tick >= t1 AND avg_ok GROUP BY run_id, entity, t1""".replace(" AND avg_ok", ""))
def first_loss(spark, sf):
    rows = PQ.labelled(spark, sf).where("grp = 'F'")
    first = rows.where("tick > inject and v > 200").groupBy("run_id", "entity").agg(F.min("tick").alias("first_tick"))
    after = rows.join(first, ["run_id", "entity"]).where("tick >= first_tick")
    out = after.groupBy("run_id", "entity", "first_tick").agg(F.avg("v").alias("mean_after"))
    return out.withColumn("fill_s", stats.fill_seconds(F.col("mean_after"), F.lit(100.0)))


SQL_VIEWS["cand"] = """SELECT run_id, tick, count(*) AS n_affected, count(*) FILTER (WHERE role = 'client') AS n_client, count(*) FILTER (WHERE role = 'client' AND rate > hi) AS n_dir, min(entity) FILTER (WHERE role = 'client') AS one, min(entity) FILTER (WHERE role = 'client' AND rate > hi) AS one_dir
  FROM (SELECT *, CASE WHEN entity IN ('link-click', 'link-view', 'link-purchase') THEN 'client' ELSE 'server' END AS role FROM cells JOIN bounds USING (entity)) WHERE ok AND (rate < lo + 20 OR rate > hi - 60) GROUP BY run_id, tick"""


def candidates(spark, sf):
    cells = V.cells(spark, sf).join(E.bounds(spark, sf), "entity").where("ok and (rate < lo + 20 or rate > hi - 60)")
    client = F.col("entity").isin("link-click", "link-view", "link-purchase")
    over = client & (F.col("rate") > F.col("hi"))
    return cells.groupBy("run_id", "tick").agg(
        F.count(F.lit(1)).alias("n_affected"), F.count_if(client).alias("n_client"), F.count_if(over).alias("n_dir"),
        F.min(F.when(client, F.col("entity"))).alias("one"), F.min(F.when(over, F.col("entity"))).alias("one_dir"),
    )


@query("localisation", "AG64 PRJ18 PRJ19 PRJ9", """
SELECT run_id, tick, n_affected, n_client, n_dir, CASE WHEN n_client = 0 THEN 'no_client' WHEN n_client = 1 THEN 'single' ELSE 'ambiguous' END AS reason, CASE WHEN n_client = 1 THEN one END AS target FROM cand""")
def localisation(spark, sf):
    reason = F.when(F.col("n_client") == 0, "no_client").when(F.col("n_client") == 1, "single").otherwise("ambiguous")
    return candidates(spark, sf).select("run_id", "tick", "n_affected", "n_client", "n_dir", reason.alias("reason"), F.when(F.col("n_client") == 1, F.col("one")).alias("target"))


@query("localisation_matrix", "AG63", """
WITH r AS (SELECT run_id, 'all' AS rule, n_client AS n, one AS c FROM cand UNION ALL SELECT run_id, 'directional', n_dir, one_dir FROM cand)
SELECT run_id, rule, CASE WHEN n = 0 THEN 'none' WHEN n > 1 THEN 'many' WHEN c = 'link-click' THEN 'correct' ELSE 'wrong' END AS outcome, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def localisation_matrix(spark, sf):
    rules = F.explode(F.array(
        F.struct(F.lit("all").alias("rule"), F.col("n_client").alias("n"), F.col("one").alias("c")), F.struct(F.lit("directional").alias("rule"), F.col("n_dir").alias("n"), F.col("one_dir").alias("c")),
    )).alias("_r")
    rows = candidates(spark, sf).select("run_id", rules).select("run_id", "_r.rule", "_r.n", "_r.c")
    outcome = F.when(F.col("n") == 0, "none").when(F.col("n") > 1, "many").when(F.col("c") == "link-click", "correct").otherwise("wrong")
    return rows.groupBy("run_id", "rule", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("scalar_figures", "FN4 FN5 FN6", f"""
SELECT p_partkey, {r6('log10(greatest(p_retailprice / 1000.0 - 1.0, 0.001))')} AS log_sep, {r6('p_retailprice * 100 / (greatest(1.0, p_size * (1 - 0.9)) * 1e6 / 8)')} AS rho, {r6('CASE WHEN p_size - 25 > 1e-9 THEN 12096000.0 / ((p_size - 25) * 1e6) END')} AS fill_s FROM part""")
def scalar_figures(spark, sf):
    p = V.table(spark, sf, "part")
    size = F.col("p_size").cast("double")
    return p.select(
        "p_partkey", stats.log_separation(F.col("p_retailprice") / 1000.0 - 1.0).alias("log_sep"),
        stats.saturation_ratio(F.col("p_retailprice") * 100, size, F.lit(0.9)).alias("rho"), stats.fill_seconds(size, F.lit(25.0)).alias("fill_s"),
    )


@query("affected_links", "GR2", """
WITH t AS (SELECT link, min(link) OVER () AS cut FROM hopl WHERE a LIKE 's%' AND b LIKE 's%'), c AS (SELECT DISTINCT cut FROM t),
f AS (SELECT DISTINCT src, dst FROM hopl JOIN c ON hopl.link = c.cut)
SELECT h.link, count(*) AS n_flows, h.link = any_value(c.cut) AS is_target FROM (SELECT DISTINCT src, dst, link FROM hopl) h JOIN f USING (src, dst), c GROUP BY h.link""")
def affected_links(spark, sf):
    _, hops = routed(spark, sf)
    used = hops.select("src", "dst", link_key(F.col("a"), F.col("b")).alias("link"), "a", "b")
    cut = F.broadcast(used.where(F.col("a").startswith("s") & F.col("b").startswith("s")).agg(F.min("link").alias("cut")))  # one link
    hit = used.join(cut, F.col("link") == F.col("cut"), "left_semi").select("src", "dst").distinct()
    parts = used.select("src", "dst", "link").distinct().join(hit, ["src", "dst"], "left_semi").groupBy("link").agg(F.count(F.lit(1)).alias("n_flows"))
    return parts.join(cut).select("link", "n_flows", (F.col("link") == F.col("cut")).alias("is_target"))
