"""Queries over all keys and rows: what stands beyond a former cut gets the same results as what stands within it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.oracle import canonical, connect
from tidemark.plans import all_queries

RUNS, SQL = all_queries()
FORECASTS = "holt_forecast theta_forecast ar1_forecast ols_trend theil_sen holt_winters ensemble_pool tti_crossing pick_tti".split()


@pytest.fixture(scope="module")
def far(spark, sf, tmp_path_factory):
    """lineitem with the suppliers' numbers moved up by 1000."""
    d = str(tmp_path_factory.mktemp("far"))
    spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_suppkey", F.col("l_suppkey") + 1000).write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize("name", FORECASTS)
def test_every_supplier_is_forecast(spark, sf, far, name):
    got = RUNS[name](spark, far).withColumn("k", F.col("k") - 1000).toPandas()
    assert len(got) and canonical(got) == canonical(connect(sf).sql(SQL[name]).df())


def test_backtest_takes_every_supplier(spark, sf, far):
    near, moved = ({r.k: r.mase for r in RUNS["backtest"](spark, d).collect()} for d in (sf, far))
    assert near and {k + 1000: pytest.approx(v) for k, v in near.items()} == moved


@pytest.mark.parametrize("name", ["hbos", "copod", "isolation_forest", "lof", "pca_reconstruction"])
def test_every_user_is_scored(spark, sf, tmp_path, name):
    """Users from 1000 on get the scores of their likes below."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("user_id", F.col("user_id") % 5)
    scores = []
    for up in (0, 1000):
        e.withColumn("user_id", F.col("user_id") + up).write.parquet(f"{tmp_path}/{up}/events.parquet")
        scores.append({(r.k - up, r.seq): (r.score, r.fired) for r in RUNS[f"rolling_{name}"](spark, f"{tmp_path}/{up}").collect()})
    assert len(scores[0]) == e.count() and scores[0] == scores[1]


def test_boosted_forecast_takes_whole_series(spark, tmp_path):
    from datetime import datetime, timedelta

    from tidemark.functions.models import boosted_forecast

    n = 260
    rows = [(k, datetime(2020, 1, 1) + timedelta(days=i), float((i * 7 + k) % 13 + (60 if i < 40 else 0))) for k in (3, 1003) for i in range(n)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.k, r.h): (r.predicted, r.lower, r.upper) for r in RUNS["boosted_forecast"](spark, str(tmp_path)).collect()}
    import numpy as np

    for k in (3, 1003):
        want = boosted_forecast(np.array([r[2] for r in rows if r[0] == k]), 6)
        assert [got[k, h] for h in range(1, 7)] == [pytest.approx(x) for x in zip(*want)]


def test_cox_sums_equal_the_fit_in_memory(spark):
    """Many ranges of time, ties within and beyond them, open intervals."""
    import numpy as np

    from tidemark.functions.models import cox_fit
    from tidemark.operators.risk import cox_proportional

    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    time = np.minimum(np.ceil(20 * rng.exponential(1 / np.exp(0.7 * x))), 60).astype(int)
    seen = (time < 60) & (rng.random(400) < 0.9)
    beta, _, hazard = cox_fit(x[:, None], time.astype(float), seen)
    df = spark.createDataFrame([(float(a), int(b), bool(c)) for a, b, c in zip(x, time, seen)], "x double, t long, e boolean")
    for part_rows in (50, 10_000):
        assert cox_proportional(df, "x", "t", "e", part_rows=part_rows) == pytest.approx((beta[0], seen.sum(), hazard[-1]), rel=1e-9)
    assert cox_proportional(df.limit(0), "x", "t", "e") == (0.0, 0, 0.0)


def test_survival_takes_every_interval(spark):
    """10,000 events at sf0.01: more than the 5000 that were once taken."""
    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/events.parquet").agg(F.count("*") - F.countDistinct("user_id")).first()[0]
    assert n > 5000 and RUNS["survival"](spark, sf).first().n_events == n


def test_priorities_half_way_between_two_roundings(spark, tmp_path):
    """Customers of the larger tables whose factors end half way between two of six digits."""
    keys = [24, 2533, 37008, 40550, 83712, 111718, 121050]
    c = spark.read.parquet("/root/testdata/sf0.1/customer.parquet")
    k = spark.createDataFrame([(x, x % 15000) for x in keys], "key long, c_custkey long")
    c.join(k, "c_custkey").withColumn("c_custkey", F.col("key")).drop("key").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = connect_parts(tmp_path)
    assert canonical(RUNS["priority_rank"](spark, str(tmp_path)).toPandas()) == canonical(con.sql(SQL["priority_rank"]).df())


def connect_parts(path):
    """connect() for tables of several files."""
    import duckdb

    con = duckdb.connect()
    for t in path.iterdir():
        con.sql(f"CREATE VIEW {t.name.removesuffix('.parquet')} AS SELECT * FROM '{t}/*.parquet'")
    return con


def test_equal_features_are_ranked_by_sums_in_order(spark, tmp_path):
    """Parts that lie in files in another order than the events': the sums' last bits are those of the events' order."""
    import random

    from tidemark.operators.explain import attribute

    rnd = random.Random(5)
    rows = [(k, 1000 * k + i, f, 0.5, v / 100) for k in range(40) for f in ("a", "b") for i, v in enumerate(rnd.sample([round(rnd.random() * 200, 2) for _ in range(50)], 50))]
    m = spark.createDataFrame(rows, "k long, seq long, method string, weight double, norm double").orderBy(F.rand(7)).repartition(5)
    got = {(r.k, r.feature): r.value for r in attribute(m, "k", F.lit(0.8), order=["seq"]).collect()}
    for k in range(40):
        c = {}
        for _, _, f, w, n in sorted(r for r in rows if r[0] == k):
            c[f] = c.get(f, 0.0) + w * n
        total = c["a"] + c["b"]
        assert {f: got[k, f] for f in c} == {f: x * 0.8 / total for f, x in c.items()}


def test_trees_are_taken_off_before_paths_are_counted(spark):
    """Hanging trees, mutual and one-way edges, loops, components: as Brandes counts them; a tree alone leaves no edges."""
    import random
    from collections import defaultdict

    from tidemark.operators import graph

    rnd = random.Random(11)
    edges = set()
    for a, b in [(i, rnd.randrange(i)) for i in range(1, 25)] + [(30, 31), (31, 32), (32, 33), (40, 41)]:
        edges |= {(a, b), (b, a)}
    edges |= {(1, 5), (5, 9), (9, 1), (2, 2), (31, 33), (33, 50), (51, 30), (12, 3)}
    ids, out = sorted({x for p in edges for x in p}), defaultdict(list)
    for a, b in edges:
        if a != b:
            out[a].append(b)
    want = dict.fromkeys(ids, 0.0)
    for s in ids:
        order, before, paths, dist = [s], defaultdict(list), defaultdict(float, {s: 1.0}), {s: 0}
        for v in order:
            for x in out[v]:
                if x not in dist:
                    dist[x] = dist[v] + 1
                    order.append(x)
                if dist[x] == dist[v] + 1:
                    paths[x] += paths[v]
                    before[x].append(v)
        load = defaultdict(float)
        for x in reversed(order):
            for v in before[x]:
                load[v] += paths[v] / paths[x] * (1 + load[x])
            if x != s:
                want[x] += load[x]
    pairs = (len(ids) - 1) * (len(ids) - 2)
    df = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "source string, target string")
    for kw in ({}, {"limit": 3, "state": 60}):
        got = {int(r.id): r.betweenness for r in graph.betweenness(df, **kw).collect()}
        assert got == {k: pytest.approx(v / pairs, abs=1e-12) for k, v in want.items()}
    tree = df.where("false").unionByName(spark.range(1, 3000).selectExpr("cast(id as string) source", "cast(id div 7 as string) target"))
    e, ids = graph._topology(graph.symmetric(tree))
    core, nodes, off = graph._without_trees(e, ids, 0)
    assert core.count() == 0 and nodes.count() == 1 and sum(x.count() for x in off) == 2999


@pytest.mark.parametrize("name", ["tfidf_cosine", "rrf", "retrieval", "copilot_answers"])
def test_searches_shuffle_no_table_of_all_terms(spark, sf, tmp_path, monkeypatch, name):
    """Lengths of documents, rows of one key included, take the terms in shares; no query makes the term table of the corpus."""
    import duckdb

    from tidemark.operators import text as X

    def refused(*a, **kw):
        raise AssertionError("all terms at once")

    monkeypatch.setattr(X, "tfidf", refused)
    for t in ("documents", "benchmark", "nation", "customer", "orders"):
        rows = duckdb.sql(f"SELECT * FROM '{sf}/{t}.parquet'" + (" LIMIT 4" if t == "benchmark" else ""))
        if t == "documents":
            rows = duckdb.sql(f"SELECT * REPLACE (CASE WHEN doc_id % 10 = 1 THEN doc_id - 1 ELSE doc_id END AS doc_id, CASE WHEN doc_id = 5 THEN NULL ELSE text END AS text) FROM '{sf}/{t}.parquet'")
        rows.write_parquet(f"{tmp_path}/{t}.parquet")
    got = RUNS[name](spark, str(tmp_path)).toPandas()
    assert len(got) and (name != "tfidf_cosine" or canonical(got) == canonical(connect(str(tmp_path)).sql(SQL[name]).df()))
