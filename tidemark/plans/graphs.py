"""Topology, correlation, explanation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import rounded
from tidemark.operators import graph as G
from tidemark.operators import relational as R
from tidemark.plans.registry import query
from tidemark.plans.views import EDGES, T, edges, table, telemetry

BFS = f"WITH RECURSIVE {EDGES}, b AS (SELECT 'region:0' AS id, 0 AS hops UNION ALL SELECT e.target, hops + 1 FROM b JOIN e ON e.source = b.id WHERE hops < 10), h AS (SELECT id, min(hops) AS hops FROM b GROUP BY id)"


def _root(spark):
    return spark.createDataFrame([("region:0",)], "id string")


@query(BFS + " SELECT id, hops FROM h")
def bfs_hops(spark, sf_dir):
    return G.bfs(edges(spark, sf_dir), _root(spark)).select("id", "hops")


@query(BFS + f", n AS (SELECT source AS id FROM e UNION SELECT target FROM e) SELECT count(*) AS n_affected, count(DISTINCT split_part(id, ':', 1)) AS n_sites, max(hops) AS max_hops, round(count(*) / ((SELECT count(*) FROM n) - 1), 6) + 0.0 AS size FROM h WHERE id <> 'region:0'")
def blast_radius(spark, sf_dir):
    e = edges(spark, sf_dir)
    nodes = e.select(F.col("source").alias("id")).union(e.select("target")).distinct().withColumn("site", F.substring_index("id", ":", 1))
    b = G.blast_radius(G.bfs(e, _root(spark)), nodes, F.lit(nodes.count()))
    return b.select("n_affected", F.size("sites").cast("long").alias("n_sites"), "max_hops", (F.round("size", 6) + 0.0).alias("size"))


ALARMS = f"{T}, a AS (SELECT seq, k AS entity, metric AS kind, us, k % 25 AS node, least(1, v / 400) AS score FROM t WHERE v > 120)"
ONCE = f"{ALARMS}, o AS (SELECT entity, kind, arg_min(seq, {{'a': us, 'b': seq}}) AS seq, min(us) AS us, arg_min(score, {{'a': us, 'b': seq}}) AS score, any_value(node) AS node, count(*) AS n_raw FROM a GROUP BY entity, kind), c AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey)"
LINKED = f"WITH RECURSIVE {ONCE}, l AS (SELECT x.seq AS a, y.seq AS b FROM o x JOIN o y ON x.seq <> y.seq AND abs(x.us - y.us) <= 3600000000 JOIN c ON c.a = x.node AND c.b = y.node), reach AS (SELECT seq AS id, seq AS r FROM o UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.id), k AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"


def correlated(spark, sf_dir):
    t = telemetry(spark, sf_dir).where("v > 120")
    alarms = t.select("seq", F.col("k").alias("entity"), F.col("metric").alias("kind"), "us", (F.col("k") % 25).alias("node"), F.least(F.lit(1.0), F.col("v") / 400).alias("score"))
    n = table(spark, sf_dir, "nation")
    e = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("source"), F.col("n_nationkey").cast("string").alias("target"))
    close = G.within_two_hops(e).where("a not like 'r%' and b not like 'r%'").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    return G.correlated(alarms, close, window=3_600_000_000)


@query(LINKED + " SELECT id AS seq, component FROM k")
def components(spark, sf_dir):
    return correlated(spark, sf_dir).select("seq", "component")


@query(LINKED + ", g AS (SELECT component, count(*) AS n_events, CAST(sum(n_raw) AS BIGINT) AS n_raw, max(score) AS peak FROM o JOIN k ON o.seq = k.id GROUP BY component) SELECT component, n_events, n_raw, round(greatest(1.0, round(n_raw / n_events, 3)) + 3.1e-8, 5) + 0.0 AS compression, CAST(row_number() OVER (ORDER BY n_events DESC, peak DESC, component) AS BIGINT) AS rank FROM g")
def compression_ratio(spark, sf_dir):
    g = G.incident_groups(correlated(spark, sf_dir))
    return g.select("component", "n_events", "n_raw", rounded(F.col("compression"), 5).alias("compression"), F.col("rank").cast("long").alias("rank"))


@query(LINKED + ", m AS (SELECT o.seq, k.component, o.us, min(o.us) OVER w AS t0, max(o.us) OVER w AS t1 FROM o JOIN k ON o.seq = k.id WINDOW w AS (PARTITION BY k.component)) SELECT seq, CASE WHEN t1 > t0 THEN round(1 - (us - t0) / (t1 - t0), 4) + 0.0 ELSE 1.0 END AS onset FROM m")
def onset_score(spark, sf_dir):
    c = correlated(spark, sf_dir)
    return c.select("seq", (G.onset_score(F.col("us"), Window.partitionBy("component")) + 0.0).alias("onset"))


@query("WITH c AS (SELECT c_custkey AS seq, c_nationkey AS g, round((c_custkey % 17) / 17, 4) AS cen, round((c_custkey % 11) / 11, 4) AS ons, round((c_custkey % 7) / 7, 4) AS cau FROM customer), s AS (SELECT *, round(greatest(cen, 0.05) * greatest(ons, 0.05) * greatest(cau, 0.05), 6) AS score FROM c) SELECT seq, g, round(score, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY g ORDER BY score DESC, seq) AS BIGINT) AS rank FROM s")
def rca_rank(spark, sf_dir):
    k = F.col("c_custkey")
    part = lambda n: F.round((k % n) / n, 4)
    c = table(spark, sf_dir, "customer").select(k.alias("seq"), F.col("c_nationkey").alias("g"), part(17).alias("centrality"), part(11).alias("onset"), part(7).alias("causal"))
    return G.root_causes(c, "g", "seq").select("seq", "g", (F.col("score") + 0.0).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH RECURSIVE {EDGES}, n AS (SELECT source AS id FROM e UNION SELECT target FROM e), c AS (SELECT source, count(*) AS kids FROM e GROUP BY source), l AS (SELECT target, source FROM e),
    nat AS (SELECT 'nation:' || n_nationkey AS id, n_regionkey AS r, coalesce(kids, 0) AS kids FROM nation LEFT JOIN c ON c.source = 'nation:' || n_nationkey), reg AS (SELECT 'region:' || r AS id, count(*) AS nats, sum(kids + 1) AS below, sum((kids + 1) * (kids + 1)) AS squares FROM nat GROUP BY r),
    size AS (SELECT nat.id, kids, below + 1 AS tree FROM nat JOIN reg ON reg.id = 'region:' || r), t AS (SELECT id, 2 * kids * (tree - kids - 1) + kids * (kids - 1) AS pairs FROM size UNION ALL SELECT id, below * below - squares FROM reg)
    SELECT n.id, round(coalesce(pairs, 0) / ((SELECT count(*) FROM n) - 1) / ((SELECT count(*) FROM n) - 2) + 3.1e-11, 8) + 0.0 AS betweenness FROM n LEFT JOIN t USING (id)"""
)
def centrality(spark, sf_dir):
    """Betweenness in the whole topology.  It is a tree for each region, so SQL can count the pairs whose way leads through a node."""
    return G.betweenness(G.symmetric(edges(spark, sf_dir))).select("id", rounded(F.col("betweenness"), 8).alias("betweenness"))


@query()
def granger(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    daily = t.groupBy((F.col("k") % 10).alias("entity"), F.floor(F.col("us") / 43_200_000_000).alias("day")).agg(F.sum("v").alias("v")).withColumn("g", F.lit(0))
    return G.granger_scores(daily, "g", "entity", ["day"], "v")


ATTR = f"{T}, m AS (SELECT k, CASE WHEN contains(metric, ':') THEN split_part(metric, ':', 2) ELSE metric END AS feature, sum(v / 100 * 0.5) AS c FROM t GROUP BY 1, 2), s AS (SELECT *, sum(abs(c)) OVER (PARTITION BY k) AS total FROM m)"


@query(f"WITH {ATTR} SELECT k, feature, round(0.8 * c / total + 3.1e-9, 6) + 0.0 AS value FROM s")
def attribution(spark, sf_dir):
    from tidemark.operators.explain import attribute

    t = telemetry(spark, sf_dir)
    return attribute(t.select("k", "seq", F.col("metric").alias("method"), F.lit(0.5).alias("weight"), (F.col("v") / 100).alias("norm")), "k", F.lit(0.8), order=["seq"]).select("k", "feature", rounded(F.col("value")).alias("value"))


@query(f"WITH {ATTR}, r AS (SELECT k, feature, 0.8 * c / total AS value FROM s) SELECT k, feature, CASE WHEN value > 1e-9 THEN 'increases_risk' WHEN value < -1e-9 THEN 'decreases_risk' ELSE 'neutral' END AS direction, CAST(row_number() OVER (PARTITION BY k ORDER BY abs(value) DESC, feature) AS BIGINT) AS rank FROM r QUALIFY rank <= 3")
def contributing_signals(spark, sf_dir):
    from tidemark.operators.explain import attribute, signals

    t = telemetry(spark, sf_dir)
    a = attribute(t.select("k", "seq", F.col("metric").alias("method"), F.lit(0.5).alias("weight"), (F.col("v") / 100).alias("norm")), "k", F.lit(0.8), order=["seq"])
    return signals(a, "k", top=3).select("k", "feature", "direction", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {T}, i AS (SELECT DISTINCT k % 25 AS root, max(v) OVER (PARTITION BY k % 25) / 500 AS risk FROM t), b AS (SELECT i.root, n2.n_nationkey AS node, i.risk FROM i JOIN nation n1 ON n1.n_nationkey = i.root JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey),
    d AS (SELECT root AS node, risk FROM i UNION ALL SELECT node, 0.5 * risk FROM b WHERE node <> root) SELECT CAST(node AS BIGINT) AS node, round(max(risk) + 3.1e-9, 6) + 0.0 AS risk FROM d GROUP BY node"""
)
def device_risk_colour(spark, sf_dir):
    from tidemark.operators.explain import device_risk

    t, n = telemetry(spark, sf_dir), table(spark, sf_dir, "nation")
    i = t.groupBy((F.col("k") % 25).alias("root")).agg((F.max("v") / 500).alias("risk"))
    reg = n.select(F.col("n_nationkey").cast("long").alias("root"), "n_regionkey").join(n.select(F.col("n_nationkey").cast("long").alias("node"), "n_regionkey"), "n_regionkey").select("root", "node")
    return device_risk(i, reg).select("node", rounded(F.col("risk")).alias("risk"))


@query(
    f"""WITH {T}, l AS (SELECT seq AS label, k, us - 43200000000 AS lo, us AS hi FROM t WHERE metric = 'error'), p AS (SELECT label, min(us) FILTER (v >= 60) AS first_us, max(v) AS peak, any_value(hi) AS hi FROM l JOIN t ON t.k = l.k AND t.us >= lo AND t.us < hi GROUP BY label)
    SELECT l.label, first_us IS NOT NULL AS detected, round((p.hi - first_us) / 1e6, 3) + 0.0 AS lead_s, round(coalesce(peak, 0), 4) + 0.0 AS peak FROM l LEFT JOIN p USING (label)"""
)
def scenario_eval(spark, sf_dir):
    """Was each labelled fault foreseen in its precursor window, how early, and how strongly?"""
    from tidemark.operators.evaluate import evaluate

    t = telemetry(spark, sf_dir)
    labels = t.where("metric = 'error'").select(F.col("seq").alias("label"), F.col("k").alias("node"), (F.col("us") - 43_200_000_000).alias("precursor_us"), F.col("us").alias("fault_us"))
    out = evaluate(labels, t.select(F.col("k").alias("node"), "us", F.col("v").alias("risk")), alert=60.0, width=43_200_000_000)
    return out.select("label", "detected", (F.round("lead_s", 3) + 0.0).alias("lead_s"), (F.round("peak", 4) + 0.0).alias("peak"))
