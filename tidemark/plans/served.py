"""Queries for serving: catalogue, timelines, questions, retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import rounded
from tidemark.operators import bank, catalogue, serving
from tidemark.plans.registry import query
from tidemark.plans.texts import BM25, TFIDF
from tidemark.plans.views import T, table, telemetry

_VALUES = ", ".join(f"('{m.rstrip('*')}', '{f}', {str(m.endswith('*')).lower()})" for f, ms in catalogue.METHODS.items() for m in ms.split())
_FAMILIES = ", ".join(f"({i}, '{f}')" for i, f in enumerate(catalogue.FAMILIES))


@query(f"WITH m(name, family, heavy) AS (VALUES {_VALUES}), f(seq, family) AS (VALUES {_FAMILIES}) SELECT CAST(seq AS INT) AS seq, f.family, count(name) AS n FROM f LEFT JOIN m ON m.family = f.family AND NOT heavy GROUP BY 1, 2")
def method_catalogue(spark, sf_dir):
    return catalogue.count_by_family(catalogue.methods(spark, light=True))


@query(f"WITH {T}, r AS (SELECT us, max(least(1, v / 150)) AS risk FROM t WHERE k = 7 GROUP BY us) SELECT us, round(risk, 4) AS risk, round(greatest(0, risk - 0.05), 4) AS lower, round(least(1, risk + 0.05), 4) AS upper, us = coalesce((SELECT min(us) FROM r WHERE risk >= 0.7), -1) AS breach FROM r")
def risk_timeline(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    r = t.select(F.concat(F.lit("site:user"), F.col("k").cast("string"), F.lit(":PE")).alias("entity"), "us", F.least(F.lit(1.0), F.col("v") / 150).alias("risk"))
    return serving.timeline(r, "site:user7:PE")


INC = "i AS (SELECT 'INC-' || n_nationkey AS incident, 'root' || n_nationkey AS root, CASE n_nationkey % 3 WHEN 0 THEN 'bgp_route_flap' WHEN 1 THEN 'tunnel_degradation' ELSE 'interface_congestion' END AS issue, n_nationkey + 1 AS rank FROM nation)"


@query(
    f"""WITH {INC}, q AS (SELECT c_custkey AS qid, CASE WHEN c_custkey % 4 = 0 THEN 'INC-' || (c_custkey % 30) END AS ref, CASE WHEN c_custkey % 4 = 1 THEN 'root' || (c_custkey % 40) END AS ent, CASE WHEN c_custkey % 4 = 2 THEN 'why is the TUNNEL slow' ELSE 'status' END AS query FROM customer),
    m AS (SELECT qid, incident, rank, 0 AS how FROM q JOIN i ON ref = incident UNION ALL SELECT qid, incident, rank, 1 FROM q JOIN i ON ent = root UNION ALL SELECT qid, incident, rank, 2 FROM q JOIN i ON issue = 'tunnel_degradation' WHERE query LIKE '%TUNNEL%' UNION ALL SELECT qid, incident, rank, 3 FROM q, i WHERE rank = 1)
    SELECT qid, arg_min(incident, {{'h': how, 'r': rank}}) AS incident, CAST(min(how) AS INT) AS how FROM m GROUP BY qid"""
)
def question_routing(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    k = F.col("n_nationkey")
    issue = F.when(k % 3 == 0, "bgp_route_flap").when(k % 3 == 1, "tunnel_degradation").otherwise("interface_congestion")
    inc = n.select(F.concat(F.lit("INC-"), k.cast("string")).alias("incident"), F.concat(F.lit("root"), k.cast("string")).alias("root"), issue.alias("issue"), (k + 1).alias("rank"))
    q = F.col("c_custkey")
    ask = c.select(
        q.alias("qid"), F.when(q % 4 == 0, F.concat(F.lit("INC-"), (q % 30).cast("string"))).alias("ref"), F.when(q % 4 == 1, F.array(F.concat(F.lit("root"), (q % 40).cast("string")))).otherwise(F.array().cast("array<string>")).alias("entities"),
        F.when(q % 4 == 2, "why is the TUNNEL slow").otherwise("status").alias("query"),
    )
    return serving.resolve(ask, inc)


@query("WITH l AS (SELECT n_nationkey AS seq, n_name AS scenario, n_regionkey AS node FROM nation), i AS (SELECT s_suppkey AS incident, [s_nationkey % 5, s_nationkey % 3] AS nodes FROM supplier), u AS (SELECT incident, unnest(nodes) AS node FROM i) SELECT incident, arg_min(scenario, seq) AS scenario FROM u JOIN l USING (node) GROUP BY incident")
def label_tagging(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    lab = n.select(F.col("n_nationkey").alias("seq"), F.col("n_name").alias("scenario"), F.col("n_regionkey").alias("node"))
    return serving.tag(lab, s.select(F.col("s_suppkey").alias("incident"), F.array(F.col("s_nationkey") % 5, F.col("s_nationkey") % 3).alias("nodes")))


@query(
    """WITH l AS (SELECT n_name AS scenario, CAST(n_nationkey AS BIGINT) AS node FROM nation), i AS (SELECT c_custkey AS incident, CASE WHEN c_custkey % 7 = 0 THEN 'NATION_' || (c_custkey % 5) END AS tag, [c_custkey % 20, c_nationkey] AS nodes FROM customer),
    a AS (SELECT scenario, incident, 0 AS how FROM l JOIN i ON tag = scenario UNION ALL SELECT scenario, incident, 1 FROM l JOIN (SELECT incident, unnest(nodes) AS node FROM i) USING (node)), b AS (SELECT scenario, arg_min(incident, {'h': how, 'r': incident}) AS incident FROM a GROUP BY 1) SELECT scenario, incident FROM l LEFT JOIN b USING (scenario)"""
)
def scenario_incident(spark, sf_dir):
    """The incident of each scenario: one with its tag before one with its node."""
    from tidemark.operators.evaluate import incident_of

    c, n = F.col("c_custkey"), table(spark, sf_dir, "nation")
    labels = n.select(F.col("n_name").alias("scenario"), F.col("n_nationkey").cast("long").alias("node"))
    tag = F.when(c % 7 == 0, F.concat(F.lit("NATION_"), (c % 5).cast("string")))
    return incident_of(labels, table(spark, sf_dir, "customer").select(c.alias("incident"), c.alias("rank"), tag.alias("tag"), F.array(c % 20, F.col("c_nationkey").cast("long")).alias("nodes")))


_RANKS = BM25 + TFIDF.replace("WITH g AS", ", g AS", 1)


@query(
    f"""{_RANKS}, al AS (SELECT doc_id FROM documents WHERE lang = 'en'), pb AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM b JOIN al USING (doc_id) WHERE rank <= 50),
    pv AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM v JOIN al USING (doc_id) WHERE rank <= 50), u AS (SELECT * FROM pb UNION ALL SELECT * FROM pv), r AS (SELECT qid, doc_id, sum(1 / (60 + rank)) AS score FROM u GROUP BY 1, 2),
    o AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r QUALIFY rank <= 5) SELECT qid, doc_id, CAST(rank AS BIGINT) AS rank, round(1 - (rank - 1) / count(*) OVER (PARTITION BY qid) + 3.1e-9, 6) + 0.0 AS score FROM o"""
)
def retrieval(spark, sf_dir):
    """Five documents for each question, among English ones."""
    docs, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    r = serving.retrieve(docs.select("doc_id", "text"), b.select(F.col("item_id").alias("qid"), F.col("text").alias("query")), "doc_id", "text", allowed=docs.where("lang = 'en'").select("doc_id"))
    return r.select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), rounded(F.col("score")).alias("score"))


@query()
def batch_detectors(spark, sf_dir):
    """The costly bank on the most anomalous series."""
    t = telemetry(spark, sf_dir)
    peaks = t.groupBy("k").agg(F.max("v").alias("risk"), F.max_by("us", "v").alias("peak"))
    return bank.batch_bank(t, ["k"], ["us", "seq"], peaks)


def _method(name):
    def run(spark, sf_dir):
        from tidemark.functions.models import Rolling
        from tidemark.operators.fold import keyed_fold

        return keyed_fold(telemetry(spark, sf_dir), ["k"], ["us", "seq"], lambda: Rolling(name), "score double, fired boolean")

    run.__name__ = f"rolling_{name}"
    return query()(run)


for _name in ("hbos", "copod", "isolation_forest", "lof", "pca_reconstruction"):
    _method(_name)


@query()
def pelt(spark, sf_dir):
    from tidemark.functions.models import Pelt
    from tidemark.operators.fold import keyed_fold

    return keyed_fold(telemetry(spark, sf_dir), ["k"], ["us", "seq"], Pelt, "pulse double, fired boolean")


@query(
    f"""WITH {T}, b AS (SELECT k, seq, us, list(v) OVER (PARTITION BY k ORDER BY us, seq ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS xs FROM t),
    w AS (SELECT k, seq, us, list_transform(range(1, len(xs) - 10), lambda i: xs[i : i + 11]) AS w FROM b WHERE len(xs) >= 48),
    z AS (SELECT k, seq, us, list_transform(w, lambda s: list_transform(s, lambda x: CASE WHEN list_aggregate(s, 'stddev_pop') > 1e-12 THEN (x - list_aggregate(s, 'avg')) / list_aggregate(s, 'stddev_pop') ELSE 0 END)) AS z FROM w),
    d AS (SELECT k, seq, us, list_min(list_transform(range(1, len(z) - 11), lambda i: sqrt(list_sum(list_transform(range(1, 13), lambda j: pow(z[i][j] - z[len(z)][j], 2)))))) AS d FROM z),
    p AS (SELECT *, list(d) OVER (PARTITION BY k ORDER BY us, seq ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS past FROM d), c AS (SELECT *, list_aggregate(past, 'quantile_cont', 0.5) AS c FROM p),
    f AS (SELECT seq, d, coalesce(len(past), 0) >= 8 AND d > c + 3 * greatest(list_aggregate(list_transform(past, lambda x: abs(x - c)), 'quantile_cont', 0.5) * 1.4826, 1e-9) AS fired FROM c)
    SELECT t.seq, round(coalesce(d, 0) + 3.1e-8, 5) + 0.0 AS distance, coalesce(fired, false) AS fired FROM t LEFT JOIN f USING (seq)"""
)
def matrix_profile(spark, sf_dir):
    """How far the latest dozen values of a user are in shape from the nearest dozen before."""
    from tidemark.functions.models import Discord
    from tidemark.operators.fold import keyed_fold

    out = keyed_fold(telemetry(spark, sf_dir), ["k"], ["us", "seq"], Discord, "distance double, fired boolean")
    return out.select("seq", rounded(F.col("distance"), 5).alias("distance"), "fired")


@query()
def boosted_forecast(spark, sf_dir):
    """Gradient-boosted lags per series: a whole series, a point a day, is one task's array."""
    from tidemark.functions.models import boosted_forecast as model
    from tidemark.plans.scoring import daily

    import numpy as np
    import pandas as pd

    def each(g: pd.DataFrame) -> pd.DataFrame:
        p, lo, hi = model(g.sort_values("day").v.to_numpy(float), 6)
        return pd.DataFrame({"k": g.k.iloc[0], "h": np.arange(1, 7), "predicted": p, "lower": lo, "upper": hi})

    return daily(spark, sf_dir).groupBy("k").applyInPandas(each, "k long, h int, predicted double, lower double, upper double")


@query()
def survival(spark, sf_dir):
    """How long until a user's next event, by the value of the last one: Cox model of the times between all events by the value before.

    The last interval of a user is open, and as long as the longest.  Intervals without a value are left out of the fit.
    """
    from tidemark.operators.risk import cox_fit

    t = telemetry(spark, sf_dir)
    w = Window.partitionBy("k").orderBy("us", "seq")
    gaps = t.select("k", (F.col("v") / 100).alias("x"), ((F.lead("us").over(w) - F.col("us")) / 1e6).alias("gap"))
    known = gaps.where("x is not null and not isnan(x)")
    longest = known.agg(F.coalesce(F.max("gap"), F.lit(0.0))).first()[0]
    model = cox_fit(known.select("x", F.coalesce("gap", F.lit(longest)).alias("gap"), F.col("gap").isNotNull().alias("seen")), "x", "gap", "seen")
    x = F.col("x")
    return gaps.where("gap is null").select("k", "x", model.expected(x).alias("eta"), model.median(x).alias("median"), F.lit(model.beta).alias("beta"), F.lit(model.n_events).alias("n_events"))
