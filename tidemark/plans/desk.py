"""Queries of an operator's desk: events as one kind, lookups, flows in a blast, questions and answers, replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import rounded
from tidemark.operators import copilot, graph, inventory
from tidemark.plans.graphs import ALARMS
from tidemark.plans.registry import query
from tidemark.plans.scoring import SCORES, scores
from tidemark.plans.views import FLOWS, T, flows, table, telemetry

_FUSED = "fu AS (SELECT id AS seq, id % 25 AS entity, max(norm) AS risk, CASE WHEN id % 3 = 0 THEN 'latency_drift' ELSE 'none' END AS issue FROM s GROUP BY id)"


def _fused(s):
    issue = F.when(F.col("id") % 3 == 0, "latency_drift").otherwise("none")
    return s.groupBy("id").agg(F.max("norm").alias("risk")).select(F.col("id").alias("seq"), F.col("id").alias("us"), (F.col("id") % 25).alias("entity"), "risk", issue.alias("issue"))


def _anomalies(s):
    return s.select("seq", F.col("id").alias("us"), (F.col("id") % 25).alias("entity"), F.col("method").alias("metric"), "method", "family", "norm", "fired")


_NORMAL = f"""{SCORES}, {_FUSED}, n AS (SELECT seq, id % 25 AS entity, norm AS score, method, family, method || '|' || family AS kind, NULL AS issue FROM s WHERE fired OR norm > 0.7
    UNION ALL SELECT seq, entity, risk, 'fusion', NULL, 'fused|' || issue, issue FROM fu WHERE risk > 0)"""


@query(f"WITH {_NORMAL} SELECT seq, entity, round(score + 3.1e-9, 6) + 0.0 AS score, kind, issue FROM n")
def normalized_events(spark, sf_dir):
    """Anomalies that fired or score high, and fused risks, as events of one kind."""
    s = scores(spark, sf_dir)
    return graph.normalized_events(_anomalies(s), _fused(s), least=0.7).select("seq", "entity", rounded(F.col("score")).alias("score"), "kind", "issue")


@query(
    f"""WITH {_NORMAL}, g AS (SELECT entity, max(score) AS peak, greatest(count(DISTINCT family), 1) AS n, count(DISTINCT CASE WHEN family IS NOT NULL THEN method END) AS m FROM n WHERE family IS NOT NULL GROUP BY entity)
    SELECT entity, round(round(peak, 4) + 3.1e-8, 5) + 0.0 AS risk, round(round(0.5 * peak + 0.5 * least(1, n / 3) * peak, 4) + 3.1e-8, 5) + 0.0 AS confidence, round(round(least(1, n / 3), 4) + 3.1e-8, 5) + 0.0 AS agreement, m AS n_methods FROM g"""
)
def made_risk(spark, sf_dir):
    """A fused risk for groups of anomalies that have none."""
    s = scores(spark, sf_dir)
    e = graph.normalized_events(_anomalies(s), _fused(s).limit(0), least=0.7)
    r = lambda c: rounded(F.col(c), 5).alias(c)
    return graph.made_risk(e, "entity").select("entity", r("risk"), r("confidence"), r("agreement"), F.size("methods").cast("long").alias("n_methods"))


@query(f"WITH {ALARMS}, c AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey), e AS (SELECT seq, us, CASE WHEN seq % 50 > 0 THEN node END AS node FROM a) SELECT x.seq AS a, y.seq AS b FROM e x JOIN e y ON x.seq < y.seq AND abs(x.us - y.us) <= 600000000 LEFT JOIN c ON c.a = x.node AND c.b = y.node WHERE x.node IS NULL OR y.node IS NULL OR c.a IS NOT NULL")
def close_pairs(spark, sf_dir):
    """Alarms near in time whose places are near, the same or unknown."""
    t = telemetry(spark, sf_dir).where("v > 120").select("seq", "us", F.when(F.col("seq") % 50 > 0, F.col("k") % 25).alias("node"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), "n_regionkey")
    close = n.withColumnRenamed("n", "a").join(n.withColumnRenamed("n", "b"), "n_regionkey").select("a", "b")
    return graph.close_pairs(t, close, window=600_000_000)


_DEVICES = "d AS (SELECT s_suppkey AS seq, s_name AS name, s_nationkey AS site, CASE s_suppkey % 3 WHEN 0 THEN 'CE' WHEN 1 THEN 'PE' ELSE 'P' END AS role FROM supplier)"


def _devices(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("seq"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("site"), F.when(k % 3 == 0, "CE").when(k % 3 == 1, "PE").otherwise("P").alias("role"))


@query(f"WITH {_DEVICES} SELECT site, min(seq) AS first FROM d GROUP BY site")
def site_order(spark, sf_dir):
    return inventory.sites(_devices(spark, sf_dir))


@query(f"WITH {_DEVICES} SELECT site, coalesce(arg_min(name, seq) FILTER (role = 'CE'), arg_min(name, seq) FILTER (role = 'PE')) AS peer FROM d WHERE role <> 'P' GROUP BY site")
def tunnel_peers(spark, sf_dir):
    return inventory.tunnel_peers(_devices(spark, sf_dir))


@query("SELECT c_custkey AS incident, CASE WHEN n_nationkey IS NULL THEN 404 ELSE 200 END AS status, n_name AS title FROM customer LEFT JOIN nation ON n_nationkey = c_custkey")
def incident_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("incident"), F.col("n_name").alias("title"))
    return inventory.incident(n, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("incident"))).select("incident", "status", "title")


@query(f"WITH {FLOWS}, r AS (SELECT CAST(n_nationkey AS BIGINT) AS root FROM nation) SELECT root, count(DISTINCT flow_id) AS n_flows, array_to_string(list_sort(list(DISTINCT vrf)), ',') AS vrfs FROM f JOIN r ON src % 25 = root OR dst = root * 10 OR dst = root * 10 + 1 GROUP BY root")
def flow_blast(spark, sf_dir):
    """Flows whose site or device lies in each blast radius, and their VRFs."""
    f = flows(spark, sf_dir).select("flow_id", (F.col("src") % 25).alias("site"), F.col("dst").alias("device"), "vrf")
    root = F.col("n_nationkey").cast("long")
    scope = table(spark, sf_dir, "nation").select(root.alias("root"), F.array(root).alias("sites"), F.array(root * 10, root * 10 + 1).alias("devices"))
    out = inventory.flows_within(f, scope)
    return out.select("root", "n_flows", F.array_join("vrfs", ",").alias("vrfs"))


_ASKED = """q AS (SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS query, o_custkey AS entity, o_custkey % 40 AS incident, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 900 AS DOUBLE) END AS eta,
        CASE WHEN o_orderkey % 5 = 0 THEN [o_orderstatus, o_orderpriority] ELSE [] END AS signals FROM orders),
    f AS (SELECT c_custkey AS entity, lower(c_mktsegment) AS issue, least(1, abs(c_acctbal) / 10000) AS confidence, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 1.0 END AS eta FROM customer WHERE c_custkey % 3 > 0),
    i AS (SELECT CAST(n_nationkey AS BIGINT) AS incident, 'bgp_route_flap' AS issue, 0.4 AS confidence, n_nationkey * 60.0 AS eta, [n_name, 'churn'] AS signals, n_name AS root FROM nation),
    x AS (SELECT qid, query, coalesce(f.issue, i.issue, 'none') AS issue, coalesce(f.confidence, i.confidence, 0) AS confidence, coalesce(q.eta, f.eta, i.eta) AS eta, CASE WHEN len(q.signals) > 0 THEN q.signals ELSE coalesce(i.signals, []) END AS signals, root FROM q LEFT JOIN f ON f.entity = q.entity LEFT JOIN i ON i.incident = q.incident)"""


def _asked(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    none = F.array().cast("array<string>")
    q = table(spark, sf_dir, "orders").select(
        k.alias("qid"), F.when(k % 3 > 0, F.col("o_orderpriority")).alias("query"), F.col("o_custkey").alias("entity"), (F.col("o_custkey") % 40).alias("incident"), F.when(k % 4 == 0, (k % 900).cast("double")).alias("eta"),
        F.when(k % 5 == 0, F.array("o_orderstatus", "o_orderpriority")).otherwise(none).alias("signals"),
    )
    fused = table(spark, sf_dir, "customer").where(c % 3 > 0).select(c.alias("entity"), F.lower("c_mktsegment").alias("issue"), F.least(F.lit(1.0), F.abs("c_acctbal") / 10000).alias("confidence"), F.when(c % 2 == 0, c.cast("double")).alias("eta"))
    n = F.col("n_nationkey").cast("long")
    inc = table(spark, sf_dir, "nation").select(n.alias("incident"), F.lit("bgp_route_flap").alias("issue"), F.lit(0.4).alias("confidence"), (n * 60.0).alias("eta"), F.array("n_name", F.lit("churn")).alias("signals"), F.col("n_name").alias("root"))
    return q, fused, inc


@query(f"WITH {_ASKED} SELECT qid, issue, round(confidence + 3.1e-9, 6) + 0.0 AS confidence, round_even(eta / 60, 1) + 0.0 AS eta_min, len(signals) AS n_signals, root FROM x")
def context_precedence(spark, sf_dir):
    """Fields of a question's context: its own before the fused risk's before the incident's."""
    out = copilot.resolved(*_asked(spark, sf_dir))
    return out.select("qid", "issue", rounded(F.col("confidence")).alias("confidence"), (F.col("eta_min") + 0.0).alias("eta_min"), F.size("signals").cast("long").alias("n_signals"), "root")


@query(f"WITH {_ASKED} SELECT qid, CASE WHEN s = '' THEN 'runbook for an incident of the network' ELSE s END AS search FROM (SELECT qid, concat_ws(' ', CASE WHEN query <> '' THEN query END, CASE WHEN issue <> 'none' THEN replace(issue, '_', ' ') END, CASE WHEN len(signals) > 0 THEN array_to_string(signals[1:5], ' ') END) AS s FROM x)")
def copilot_search(spark, sf_dir):
    """What is looked up for each question."""
    out = copilot.resolved(*_asked(spark, sf_dir))
    return out.select("qid", copilot.search_text(F.coalesce("query", F.lit("")), F.col("issue"), F.col("signals")).alias("search"))


@query()
def copilot_answers(spark, sf_dir):
    """Benchmark items as questions about incidents, answered from the documents."""
    b, n = table(spark, sf_dir, "benchmark"), F.col("n_nationkey").cast("long")
    k = F.col("item_id")
    q = b.select(k.alias("qid"), F.col("text").alias("query"), k.alias("entity"), (k % 40).alias("incident"), F.lit(None).cast("double").alias("eta"), F.array().cast("array<string>").alias("signals"))
    _, fused, _ = _asked(spark, sf_dir)
    inc = table(spark, sf_dir, "nation").select(n.alias("incident"), F.lit("bgp_route_flap").alias("issue"), F.lit(0.4).alias("confidence"), (n * 60.0).alias("eta"), F.array("n_name").alias("signals"), F.col("n_name").alias("root"))
    corpus = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return copilot.answers(q, fused, inc, corpus)


@query(f"WITH {T}, p AS (SELECT seq, us, lag(us) OVER (ORDER BY us) AS b FROM t) SELECT seq, round(coalesce(us - b, 0) / 1e6 / 60 + 3.1e-9, 6) + 0.0 AS pause_s FROM p")
def paced_replay(spark, sf_dir):
    """How long a replay at sixty times the speed waits before each event."""
    from tidemark.sources.feeds import pauses

    return pauses(telemetry(spark, sf_dir), speed=60.0).select("seq", rounded(F.col("pause_s")).alias("pause_s"))
