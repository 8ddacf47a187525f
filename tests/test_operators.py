from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions.columns import entity_id, normal_cdf
from tidemark.operators import explain, forecast, fusion, graph, relational, risk, sketches, text
from tidemark.operators.fold import keyed_fold


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def series(spark, xs, key="a"):
    return frame(spark, [(key, i, float(x)) for i, x in enumerate(xs)], "k string, i long, v double")


def test_fold_isolates_keys_and_skips_nulls(spark):
    df = frame(spark, [("a", 0, 1.0), ("b", 0, 100.0), ("a", 1, None), ("a", 2, 3.0), ("b", 1, float("nan")), (None, 0, 5.0)], "k string, i long, v double")
    out = {(r.k, r.i): r.m for r in keyed_fold(df, ["k"], ["i"], lambda: K.LevelDrift(0.5), "m double, d double").collect()}
    assert out == {("a", 0): 1.0, ("a", 1): None, ("a", 2): 2.0, ("b", 0): 100.0, ("b", 1): None, (None, 0): 5.0}


def test_entity_id_skips_empty_labels(spark):
    df = frame(spark, [("s", "d", "PE", {"interface": "", "peer": "x"}), ("s", "d", "PE", {})], "a string, b string, c string, l map<string,string>")
    assert [r.e for r in df.select(entity_id(F.col("a"), F.col("b"), F.col("c"), F.col("l")).alias("e")).collect()] == ["s:d:PE:x", "s:d:PE"]


def test_normal_cdf(spark):
    r = spark.range(1).select(*(normal_cdf(F.lit(z)).alias(f"c{i}") for i, z in enumerate((-1.96, 0.0, 1.0)))).first()
    assert tuple(r) == pytest.approx((0.0249979, 0.5, 0.8413447), abs=1e-6)


def test_map_to_node(spark):
    nodes = frame(spark, [("s:d:PE", 0), ("s:d", 2), ("t:e:CE", 1)], "id string, node_seq int")
    ents = frame(spark, [("s:d:PE:e1",), ("s:d",), ("t:e:host",), ("u:x",)], "entity string")
    assert {r.entity: r.node for r in relational.map_to_node(ents, nodes).collect()} == {"s:d:PE:e1": "s:d:PE", "s:d": "s:d", "t:e:host": "t:e:CE", "u:x": None}


def test_interval_and_near_pairs_by_hand(spark):
    r = np.random.default_rng(0)
    pts = [(i, int(t)) for i, t in enumerate(r.integers(0, 1000, 80))]
    spans = [(i, int(a), int(a + w)) for i, (a, w) in enumerate(zip(r.integers(0, 900, 20), r.integers(1, 200, 20)))]
    got = relational.interval_join(frame(spark, pts, "p long, t long"), frame(spark, spans, "s long, lo long, hi long"), "t", "lo", "hi", width=50).select("p", "s").collect()
    assert sorted(map(tuple, got)) == sorted((p, s) for p, t in pts for s, a, b in spans if a <= t < b)
    near = relational.near_pairs(frame(spark, pts, "p long, t long"), "t", "p", 30, []).collect()
    assert sorted((x.a_p, x.b_p) for x in near) == sorted((p, q) for p, t in pts for q, u in pts if p < q and abs(t - u) <= 30)


def test_asof(spark):
    left = frame(spark, [("a", 1, 5), ("a", 2, 10), ("b", 3, 1)], "k string, id long, t long")
    right = frame(spark, [("a", 5, 1.0), ("a", 9, 2.0), ("a", 11, 3.0), ("b", 2, 9.0)], "k string, u long, v double")
    assert {r.id: r.v for r in relational.asof_latest(left, right, "k", "t", "u", "v").collect()} == {1: 1.0, 2: 2.0, 3: None}


def test_sketches(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).cast("string").alias("u"), (F.rand(3) * 100 + 1).alias("v"), F.lit("g").alias("g"))
    assert sketches.distinct_sketch(df, "g", "u").first().n == pytest.approx(5000, rel=0.1)
    q, exact = sketches.log_quantiles(df, "g", "v", [0.5, 0.99]).first(), df.select(F.percentile("v", F.array(F.lit(0.5), F.lit(0.99)))).first()[0]
    assert (q.p50, q.p99) == pytest.approx(exact, rel=0.02)
    cm = sketches.count_min(df.where("u < 900"), "u").collect()
    assert all(r.estimate >= r.exact for r in cm)


def test_fusion_agreement(spark):
    cols = "k string, method string, family string, norm double, fired boolean"
    one = [("one", f"m{i}", "statistical", 0.9 if i == 0 else 0.1, False) for i in range(4)]
    many = [("many", f"m{i}", f, 0.9, True) for i, f in enumerate(("statistical", "change_point", "deep", "graph"))]
    none = [("none", "m", "deep", 0.0, False)]
    r = {x.k: x for x in fusion.fuse(frame(spark, one + many + none, cols), ["k"]).collect()}
    assert r["many"].agreement > r["one"].agreement and r["many"].risk > r["one"].risk > r["none"].risk == 0
    assert r["none"].confidence <= 0.1 and r["many"].n_methods == 4
    six = [("six", f"m{i}", "deep", 0.9 if i == 5 else 0.1, False) for i in range(7)]
    both = {x.k: x for x in fusion.fuse(frame(spark, one + six, cols), ["k"], many=True).collect()}
    assert both["one"].risk == r["one"].risk and both["six"].fused > (0.9 + 6 * 0.1) / 7
    hints = spark.range(1).select(fusion.issue_hint(F.lit("routing"), F.lit(0.5)).alias("a"), fusion.issue_hint(F.lit("deep"), F.lit(0.5)).alias("b"), fusion.issue_hint(F.lit("routing"), F.lit(0.0)).alias("c")).first()
    assert tuple(hints) == ("bgp_route_flap", "none", "none")


def test_risk_monotone(spark):
    df = frame(spark, [(0.0,), (60.0,), (600.0,), (None,)], "eta double")
    assert [r.u for r in df.select(risk.urgency(F.col("eta")).alias("u")).collect()] == pytest.approx([1, 0.5, 1 / 11, 0.05], abs=1e-6)


def test_calibration(spark):
    r = np.random.default_rng(7)
    p = r.random(2000)
    y = (r.random(2000) < p**2).astype(int)
    df = frame(spark, list(zip(p.tolist(), y.tolist())), "p double, y int")
    brier = lambda c: df.select(risk.brier(c, F.col("y"))).first()[0]
    for model in (risk.Platt().fit(df, "p", "y"), risk.Isotonic().fit(df, "p", "y")):
        assert brier(model.apply(F.col("p"))) <= brier(F.col("p"))
        xs = [x[0] for x in df.select(model.apply(F.col("p"))).orderBy("p").collect()]
        assert all(a <= b + 1e-9 for a, b in zip(xs, xs[1:]))
    assert risk.Platt().fit(df.where("y = 1"), "p", "y").a == 1.0


def test_bfs_blast_and_components(spark):
    e = frame(spark, [("hub", "b1"), ("hub", "b2"), ("b1", "h"), ("h", "b1"), ("x", "hub")], "source string, target string")
    hops = {r.id: r.hops for r in graph.bfs(e, frame(spark, [("hub",)], "id string")).collect()}
    assert hops == {"hub": 0, "b1": 1, "b2": 1, "h": 2}
    nodes = frame(spark, [(n, f"s-{n}", ["V"] if n == "h" else []) for n in ("hub", "b1", "b2", "h", "x")], "id string, site string, services array<string>")
    b = graph.blast_radius(graph.bfs(e, frame(spark, [("hub",)], "id string")), nodes, F.lit(5)).first()
    assert (b.n_affected, b.size, b.services, b.sites) == (3, 0.75, ["V"], ["s-b1", "s-b2", "s-h"])
    n = 40
    pairs = frame(spark, [(i, i + 1) for i in range(n - 1)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in graph.components(pairs, frame(spark, [(i,) for i in (*range(n), 100, 101, 500)], "id long")).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100, 500: 500}


def test_centrality_and_granger(spark):
    star = frame(spark, [("c", x) for x in "abd"] + [(x, "c") for x in "abd"], "source string, target string")
    c = {r.id: r for r in graph.centrality(star).collect()}
    assert c["c"].betweenness == pytest.approx(1) and c["c"].eigenvector > c["a"].eigenvector
    assert graph.f_survival(4.0, 2, 20) == pytest.approx(0.0346, abs=2e-3)
    r = np.random.default_rng(1)
    x = r.normal(size=120)
    y = np.concatenate(([0.0], 0.9 * x[:-1])) + 0.1 * r.normal(size=120)
    rows = [("g", "x", i, float(v)) for i, v in enumerate(x)] + [("g", "y", i, float(v)) for i, v in enumerate(y)]
    s = {t.cause: t.causal for t in graph.granger_scores(frame(spark, rows, "g string, e string, i long, v double"), "g", "e", ["i"], "v").collect()}
    assert s["x"] > 0.99 and s["x"] > s["y"]


def test_grouping_keeps_far_events_apart(spark):
    close = frame(spark, [("n", "n"), ("n", "m"), ("m", "n"), ("m", "m"), ("z", "z")], "a string, b string")
    ev = [(0, "e0", "k", 0, "n", 0.5), (1, "e1", "k", 50, "m", 0.9), (2, "e0", "k", 10, "n", 0.4), (3, "e3", "k", 20, "z", 0.8), (4, "e4", "k", 10_000, "n", 0.7), (5, "e5", "k", 10_020, None, 0.1)]
    g = graph.correlated(frame(spark, ev, "seq long, entity string, kind string, us long, node string, score double"), close, window=300)
    assert {r.seq: r.component for r in g.collect()} == {0: 0, 1: 0, 3: 3, 4: 4, 5: 4}
    inc = {r.component: r for r in graph.incident_groups(g).collect()}
    assert inc[0].entities == ["e0", "e1"] and inc[0].compression == 1.5 and inc[0].rank == 1


def test_forecasts(spark):
    ramp = series(spark, np.arange(60) * 1.5 + 3)
    for model in (forecast.holt, forecast.theta):
        out = {r.h: r for r in model(ramp, "k", ["i"], "v", 5).collect()}
        assert out[5].predicted == pytest.approx(3 + 1.5 * 64, rel=0.1) and out[5].upper - out[5].lower > out[1].upper - out[1].lower
    flat = forecast.ar1(series(spark, [5.0, 5.0, 5.0, 5.0]), "k", ["i"], "v", 3).collect()
    assert all(r.predicted == pytest.approx(5) for r in flat)
    s = forecast.theil_sen(ramp, "k", ["i"], "v").first()
    assert s.slope == pytest.approx(1.5) and s.lower <= s.slope <= s.upper
    assert forecast.backtest_mase(ramp, "k", ["i"], "v", forecast.holt).first().mase < 2


def test_crossing(spark):
    pts = frame(spark, [("up", h, 10.0 * h, 8.0 * h, 12.0 * h, 0.0, 0.9) for h in range(1, 6)] + [("flat", h, 1.0, 0.5, 1.5, 1.0, 0.9) for h in range(1, 6)] + [("over", h, 50.0, 49.0, 51.0, 99.0, 0.9) for h in range(1, 6)], "k string, h int, predicted double, lower double, upper double, now double, agreement double")
    r = {x.k: x for x in forecast.crossing(pts, ["k"], "now", F.lit(35.0), seconds=2.0).collect()}
    assert r["up"].eta == pytest.approx(7.0) and r["up"].eta_lower < 7 < r["up"].eta_upper
    assert r["flat"].eta is None and r["flat"].confidence == pytest.approx(0.6 * 0.9) and r["over"].eta == 0


def test_explanations(spark):
    m = frame(spark, [("i", "z:latency_ms", 1.0, 0.8), ("i", "loss", 1.0, 0.2)], "k string, method string, weight double, norm double")
    a = explain.signals(explain.attribute(m, "k", F.lit(0.5)), "k").collect()
    assert [(r.feature, round(r.value, 3), r.direction) for r in a] == [("latency_ms", 0.4, "increases_risk"), ("loss", 0.1, "increases_risk")]
    assert a[0].meaning.startswith("Delay on the path adds to the risk")
    imp = explain.permutation_importance(frame(spark, [(5.0, 1.0)], "a double, b double"), lambda c: 2 * c["a"] + 0 * c["b"], ["a", "b"], {"a": [0.0], "b": [0.0]}).first()
    assert (imp.imp_a, imp.imp_b) == (10.0, 0.0)


def test_text_tools(spark):
    docs = frame(spark, [("d", "---\ntitle: A: b\nsites: [x, y]\n---\nintro\n# One\nbody 1\n## Two\nbody 2")], "id string, text string")
    assert docs.select(text.front_matter(F.col("text")).alias("m")).first().m == {"title": "A: b", "sites": "[x, y]"}
    assert [(r.title, r.body) for r in text.sections(docs, "id", "text").orderBy("n").collect()] == [("", "intro"), ("One", "body 1"), ("Two", "body 2")]
    r = spark.range(1).select(text.faithfulness(F.lit("The link is saturated. Router pe1 rebooted today."), F.lit("link saturated on router pe1")).alias("f"), text.faithfulness(F.lit(""), F.lit("x")).alias("e")).first()
    assert r.f == pytest.approx((1 / 2 + 2 / 4) / 2) and r.e == 1.0  # a full stop belongs to its token
    a = frame(spark, [(1, ["a", "b", "a"], 0.9), (2, ["z"], 0.9)], "id long, c array<string>, conf double")
    g = {x.id: x for x in text.gate(a, "c", F.array(F.lit("a")), "conf").collect()}
    assert g[1].cited == ["a"] and g[1].dropped == ["b"] and g[2].abstains and g[2].conf == 0.2


def test_cosine_in_blocks(spark):
    r = np.random.default_rng(0)
    v = frame(spark, [(i, [float(x) for x in r.normal(size=6)]) for i in range(60)], "id long, e array<double>")
    q = v.where("id % 5 = 0").select(F.col("id").alias("q"), "e")
    whole, dealt = (sorted(map(tuple, text.cosine_topk(v, q, "id", "q", "e", 4, block=b).collect())) for b in (100, 3))
    assert whole == dealt and len(whole) == 48 and all(i == q for q, i, _, n in whole if n == 1)


def test_serving(spark):
    from tidemark.operators import serving

    inc = frame(spark, [("a", 0.8), ("c", 0.2)], "root string, risk double")
    blast = frame(spark, [("a", "b"), ("a", "a"), ("c", "b")], "root string, node string")
    nodes, edges = serving.coloured(inc, blast, frame(spark, [("a",), ("b",), ("z",)], "id string"), frame(spark, [("a", "b"), ("b", "a"), ("b", "z")], "source string, target string"))
    assert {r.id: r.risk for r in nodes.collect()} == {"a": 0.8, "b": 0.4, "z": 0.0}
    assert {(r.source, r.target): r.risk for r in edges.collect()} == {("a", "b"): 0.8, ("b", "z"): 0.4}
    reached = frame(spark, [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)], "root string, id string, hops int")
    assert [r.fact for r in serving.facts(reached).orderBy("hops").collect()] == ["a reaches b within 1 hop(s)", "a reaches c within 2 hop(s)"]
    p = serving.prompt(frame(spark, [(1, "x", "", "q")], "id long, analytics string, documents string, question string")).first().prompt
    assert p == "## analytics\nx\n\n## question\nq"
    ev = frame(spark, [("s", True, 10.0, 0.5), ("t", False, None, 0.1)], "scenario string, detected boolean, lead_s double, peak double")
    assert all(not r.all_detected for r in serving.summary(ev).collect())
    risks = frame(spark, [("s:d:PE:e1", 5, 0.8), ("s:d:PE:e1", 6, 0.9), ("s:x:PE", 5, 0.1)], "entity string, us long, risk double")
    got = serving.timeline(risks, "s:d:PE").orderBy("us").collect()
    assert [(r.us, r.breach) for r in got] == [(5, True), (6, False)] and got[1].upper == 0.95
    assert serving.timeline(risks, "q:q").count() == 0


def test_retrieval_filters_after_the_pool(spark):
    from tidemark.operators import serving

    docs = frame(spark, [(i, t) for i, t in enumerate(["link pe1 saturated", "tunnel rekey early", "link down", "bgp flap on pe1", "nothing here"])], "id long, text string")
    q = frame(spark, [(1, "pe1 link saturated")], "qid long, query string")
    assert [r.id for r in serving.retrieve(docs, q, "id", "text", k=2).orderBy("rank").collect()][0] == 0
    left = serving.retrieve(docs, q, "id", "text", k=3, allowed=docs.where("id > 0").select("id")).collect()
    assert left and all(r.id > 0 for r in left) and max(r.score for r in left) == 1.0


def test_approximate_quantiles_bound_memory(spark):
    df = spark.range(5000).select(F.lit("a").alias("k"), (F.rand(1) * 10).alias("v"))
    exact, near = (fusion.robust_standard(df, ["k"], "v", accuracy=a).agg(F.avg("z"), F.max("z")).first() for a in (None, 1000))
    assert tuple(near) == pytest.approx(tuple(exact), abs=0.02)
