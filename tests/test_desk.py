"""Numbering, links, calibration, impact times, lookups and feeds against plain versions of them."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.operators import forecast as FC
from tidemark.operators import fusion, graph, inventory, relational, risk


def test_numbers_and_running_totals(spark):
    r = random.Random(1)
    rows = [(i, r.choice("ab"), r.randint(0, 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, k string, v long").repartition(7)
    got = {x.i: x.rank for x in relational.numbered(df, [F.desc("v"), "i"]).collect()}
    assert got == {x[0]: n for n, x in enumerate(sorted(rows, key=lambda x: (-x[2], x[0])), 1)}
    total = {(x.k, x.v, x.i): x.upto for x in relational.running_total(df, ["k"], ["v", "i"], F.col("v"), "upto").collect()}
    assert total == {(k, v, i): sum(y for j, q, y in rows if q == k and (y, j) <= (v, i)) for i, k, v in rows}
    share = {x.i: (x.at_most, x.at_least) for x in fusion.shares(df, ["k"], "v").collect()}
    for i, k, v in rows:
        own = [y for _, q, y in rows if q == k]
        assert share[i] == pytest.approx((sum(y <= v for y in own) / len(own), sum(y >= v for y in own) / len(own)))
    assert relational.numbered(df.limit(0), ["v"]).count() == 0


def test_links_give_the_components_of_all_pairs(spark):
    r = random.Random(2)
    for trial in range(4):
        n, window = 60, 10
        rows = [(i, f"e{i}", "k", r.randint(0, 300), r.choice([None, *"abcd"]) if r.random() < 0.8 else "a", 0.5) for i in range(n)]
        close = [("a", "b"), ("b", "a"), ("c", "c")] if trial % 2 else [("a", "b"), ("b", "c"), ("b", "a"), ("c", "b")]
        up = list(range(n))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for i, _, _, t, a, _ in rows:
            for j, _, _, s, b, _ in rows[:i]:
                if abs(t - s) <= window and (a is None or b is None or a == b or (a, b) in close):
                    x, y = find(i), find(j)
                    up[max(x, y)] = min(x, y)
        events = spark.createDataFrame(rows, "seq long, entity string, kind string, us long, node string, score double")
        got = graph.correlated(events, spark.createDataFrame(close, "a string, b string"), window=window).collect()
        assert {x.seq: x.component for x in got} == {i: find(i) for i in range(n)}


def test_isotonic_steps_over_many_ranges(spark):
    r = np.random.default_rng(4)
    x = np.concatenate((r.uniform(0, 1, 3000), np.repeat(0.5, 50)))
    y = (r.uniform(size=len(x)) < x).astype(int)
    blocks = []
    for v in sorted(set(x.tolist())):
        risk.pool(blocks, (v, float(y[x == v].sum()), int((x == v).sum())))
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "p double, y int").repartition(9)
    got = risk.Isotonic().fit(df, "p", "y").knots
    assert got == [(b[0], b[1] / b[2]) for b in blocks] and [k[1] for k in got] == sorted({k[1] for k in got})
    fitted = {b[0]: b[1] / b[2] for b in blocks}
    edges = sorted(fitted)
    best = lambda i, xs, ys: max(min(ys[j : k + 1].mean() for k in range(i, len(ys))) for j in range(i + 1))
    xs = np.sort(r.uniform(0, 1, 25))
    ys = (r.uniform(size=25) < xs).astype(float)
    small = risk.Isotonic().fit(spark.createDataFrame(list(zip(xs.tolist(), ys.tolist())), "p double, y double"), "p", "y").knots
    for i in range(25):
        assert next(v for e, v in small if xs[i] <= e) == pytest.approx(best(i, xs, ys))
    assert edges


def test_expected_time_of_a_cox_model(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=300)
    time = np.ceil(20 * r.exponential(1 / np.exp(0.7 * x)))
    df = spark.createDataFrame([(float(a), float(t), True) for a, t in zip(x, time)], "x double, t double, e boolean")
    m = risk.cox_fit(df, "x", "t", "e", knots=10_000)
    times = sorted(set(time.tolist()))
    w = np.exp(m.beta * (x - x.mean()))
    hazard = np.cumsum([(time == t).sum() / w[time >= t].sum() for t in times])
    assert m.times == times and m.hazard == pytest.approx(hazard.tolist())
    for a in (-1.0, 0.3, 2.0):
        lives = np.exp(-np.concatenate(([0.0], hazard)) * np.exp(m.beta * (a - x.mean())))
        row = spark.range(1).select(m.expected(F.lit(a)).alias("mean"), m.median(F.lit(a)).alias("half")).first()
        assert row.mean == pytest.approx((np.diff([0.0, *times]) * lives[:-1]).sum())
        assert row.half == next((t for t, s in zip(times, lives[1:]) if s <= 0.5), None)


def test_first_estimate_that_foresees_an_impact(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k long, eta double, eta_lower double, eta_upper double, confidence double")
    a, b, c = rows((1, 5.0, 4.0, 6.0, 0.9), (2, None, None, None, 0.6), (3, None, None, None, 0.6), (4, None, None, None, 0.5)), rows((1, 1.0, 1.0, 1.0, 0.1), (2, 7.0, None, 9.0, 0.4)), rows((2, 1.0, 1.0, 1.0, 0.7), (3, 8.0, 2.0, 8.0, 0.7))
    got = {r.k: (r.method, r.eta, r.confidence) for r in FC.first_estimate("k", [("trajectory", a), ("trend", b), ("survival", c)]).collect()}
    assert got == {1: ("trajectory", 5.0, 0.9), 2: ("trend", 7.0, 0.4), 3: ("survival", 8.0, 0.7), 4: ("healthy", None, 0.5)}


@pytest.mark.parametrize("slope,lower,upper,last,above,want", [(2, 1, 4, 80, True, (10, 5, 20)), (-2, -4, -1, 80, True, (None, None, None)), (-2, -4, 1, 120, False, (10, 5, 5)), (0, -1, 1, 100, True, (None, 0, 0)), (1, 0, 2, 130, True, (0, 0, 0))])
def test_trend_extrapolated(spark, slope, lower, upper, last, above, want):
    t = spark.createDataFrame([(1, float(slope), float(lower), float(upper), float(last), 30)], "k long, slope double, lower double, upper double, last double, n long")
    r = FC.extrapolated(t, "k", F.lit(100.0), above=above).first()
    assert (r.eta, r.eta_lower, r.eta_upper) == want


def test_forests_of_several_features_and_frozen():
    r = np.random.default_rng(5)
    forest = K.HalfSpaceTrees(window=100, dims=2)
    for _ in range(400):
        forest.step((r.uniform(40, 60), r.uniform(10, 20)))
    inside = np.mean([forest.step((r.uniform(40, 60), r.uniform(10, 20)))[0] for _ in range(50)])
    assert forest.step((40.0, 95.0))[0] > inside
    frozen = K.FrozenForest(warm=100)
    xs = r.normal(50, 2, 100)
    assert not any(frozen.step(x)[1] for x in xs)
    centre = np.median(xs)
    assert frozen.lo == pytest.approx(centre - 4 * 1.4826 * np.median(np.abs(xs - centre)))
    calm = [frozen.step(x) for x in r.normal(50, 2, 60)]
    far, fired = frozen.step(90.0)
    assert far > np.median([c for c, _ in calm]) and not any(f for _, f in calm)
    assert fired == ((far - frozen.centre) / frozen.scale >= 3.5)
    keen = K.FrozenForest(warm=40, limit=0.5, window=40)
    for x in r.normal(50, 2, 40):
        keen.step(x)
    assert keen.step(90.0)[1]


def test_inventory(spark):
    d = spark.createDataFrame([(0, "p1", "x", "P", ["A"]), (1, "c2", "y", "CE", ["A", "B"]), (2, "e1", "y", "PE", []), (3, "c1", "y", "CE", ["B"]), (4, "e2", "x", "PE", ["A"])], "seq int, name string, site string, role string, vrfs array<string>")
    assert inventory.by_name(d, "c1").first().seq == 3
    with pytest.raises(KeyError):
        inventory.by_name(d, "c9")
    assert [r.name for r in inventory.by_role(d, "CE").collect()] == ["c2", "c1"]
    assert {r.site: r.first for r in inventory.sites(d).collect()} == {"x": 0, "y": 1}
    assert {r.site: r.peer for r in inventory.tunnel_peers(d).collect()} == {"x": "e2", "y": "c2"}
    ids = d.select(inventory.sub_entity(F.col("site"), F.col("name"), F.col("role"), F.lit("eth1")).alias("i"), inventory.slas(F.col("vrfs"), {"A": "gold", "B": "iron"}).alias("s")).collect()
    assert ids[1].i == "y:c2:CE:eth1" and ids[1].s == ["gold", "iron"] and ids[2].s == []


def test_feeds(spark, tmp_path):
    from tidemark.sources import feeds, generator

    with pytest.raises(ValueError):
        feeds.Generated(spark, generator.Config(), seed=2)
    g = feeds.Generated(spark, duration_s=60.0, scenarios=("tunnel",))
    rows = g.all_records()
    times = [r.us for r in rows.select("us").collect()]
    assert times == sorted(times) and {r.kind for r in rows.select("kind").distinct().collect()} >= {"TelemetryRecord", "FlowRecord"}
    assert g.labels().count() == 1 and feeds.Lab().labels() is None
    with pytest.raises(NotImplementedError):
        feeds.Lab().records()
    few = spark.createDataFrame([(i, t) for i, t in enumerate([0, 500_000, 200_000_000, 200_000_000])], "i int, us long")
    waits = []
    got = [r.i for r in feeds.paced(few, speed=2.0, sleep=waits.append)]
    assert got[:2] == [0, 1] and waits == [0.25, 99.75]
    with pytest.raises(ValueError):
        feeds.pauses(few, speed=0)
    assert [r.us for r in feeds.Replayed(few.orderBy(F.desc("us"))).records().collect()] == [0, 500_000, 200_000_000, 200_000_000]
    seen = []
    feeds.append_label(spark, str(tmp_path / "labels"), {"scenario": "tunnel"}, lambda: seen.append(spark.read.text(str(tmp_path / "labels")).count()))
    assert seen == [1]
    out = list(feeds.frames(iter([{"risk": 0.5}, {"risk": 0.7}, {"risk": 0.1}]), limit=2))
    assert len(out) == 4 and out[1] == 'event: risk\ndata: {"risk": 0.5}\n\n' and out[-1].startswith("event: end")
    flows = spark.createDataFrame([(0, "d", 10, 1, 5), (9_000_000, "d", 1, 1, None), (10_000_000, "d", 2, 2, 1)], "us long, device string, bytes long, packets long, sampling_rate int")
    assert sorted((r.window, r.bytes, r.packets, r.n) for r in feeds.collected_flows(flows).collect()) == [(0, 51, 6, 2), (1, 2, 2, 1)]


def test_durable_consumer(spark, tmp_path):
    """Read on from the cursor after a restart; repeats within the window are passed by; old messages are past retention."""
    from tidemark.streaming import stateful as S

    path, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    df = spark.createDataFrame([("a", 100, 1.0), ("a", 100, 1.0), ("b", 102, 2.0)], "key string, t long, v double").withColumn("ts", F.timestamp_seconds("t"))

    def once():
        q = S.follow(spark, path, df.schema, lambda s: s.withColumn("v", F.col("v") * 10), out, ck, fmt="parquet", once_within="10 minutes", key="key", ts="ts")
        assert q.awaitTermination(120)
        return sorted((r.key, r.v) for r in spark.read.parquet(out).collect())

    df.write.parquet(path)
    assert once() == [("a", 10.0), ("b", 20.0)]
    spark.createDataFrame([("c", 103, 3.0)], "key string, t long, v double").withColumn("ts", F.timestamp_seconds("t")).write.mode("append").parquet(path)
    assert once() == [("a", 10.0), ("b", 20.0), ("c", 30.0)]
    assert sorted(r.key for r in S.expired(spark, out, "ts", "2 seconds").collect()) == ["a"]


def test_command_line_options(spark, tmp_path, capsys):
    import json

    from tidemark import cli

    args = cli.parser().parse_args(["generate", "--out", "x", "--start", "2025-03-01T10:00", "--no-flows"])
    assert args.start == 1_740_823_200_000_000 and args.no_flows and not args.no_syslog
    assert cli.main(["generate", "--out", str(tmp_path / "o"), "--duration", "120", "--no-syslog"]) == 0
    counts = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert counts["FlowRecord"] > 0 and "SyslogEvent" not in counts


def test_searches_for_change_points():
    from tidemark.functions import models as M

    r = np.random.default_rng(6)
    xs = np.concatenate((r.normal(0, 1, 40), r.normal(6, 1, 30), r.normal(-3, 1, 50)))
    squares = lambda a, b: ((xs[a:b] - xs[a:b].mean()) ** 2).sum()
    first = max(range(5, 116), key=lambda t: squares(0, 120) - squares(0, t) - squares(t, 120))
    assert first in M.binary_segmentation(xs, 20.0)
    for search in M.SEARCHES.values():
        got = search(xs, 60.0)
        assert len(got) == 2 and abs(got[0] - 40) <= 2 and abs(got[1] - 70) <= 2
        assert search(r.normal(0, 1, 100), 60.0) == []
    k = M.Pelt(search="binseg")
    assert any(k.step(x)[1] for x in np.concatenate((np.zeros(100), np.full(20, 9.0))))


def test_isolation_forest_by_hand():
    """Depths of its trees against a walk down each of them."""
    from tidemark.functions import models as M

    r = np.random.default_rng(2)
    rows = np.vstack((r.normal(size=(100, 3)), np.zeros((20, 3))))
    score = M.isolation_forest(rows, trees=20)
    feature, cut, depth, first, norm = (dict(zip(score.__code__.co_freevars, (c.cell_contents for c in score.__closure__)))[n] for n in ("feature", "cut", "depth", "first", "norm"))
    for v in (rows[0], rows[110], np.full(3, 9.0)):
        depths = []
        for root in first:
            node = root
            while feature[node] >= 0:
                node = root + 2 * (node - root) + 1 + int(v[feature[node]] >= cut[node])
            depths.append(depth[node])
        assert score(v[None])[0] == pytest.approx(2 ** -(np.mean(depths) / norm))
    assert score(np.full((1, 3), 9.0))[0] > 0.6 > score(np.zeros((1, 3)))[0]


def test_ledger_of_alerts():
    ledger, last, kept = K.AlertLedger(window=10, most=3), {}, []
    r = random.Random(3)
    for t in range(200):
        key = r.choice("abcdef")
        want = key not in last or last[key] < t - 10
        if want:
            last.pop(key, None)
            last[key] = t
            if len(last) > 3:
                del last[min(last, key=last.get)]
        passes, n, s = ledger.step(None, t, key)
        kept.append(passes)
        assert passes == want and n == sum(kept) and n + s == t + 1


def brandes(out):
    """Betweenness by counting, for each pair, the shortest paths through each node."""
    n = len(out)
    total = np.zeros(n)
    for s in range(n):
        order, before, paths, dist = [s], [[] for _ in out], np.zeros(n), np.full(n, -1)
        paths[s], dist[s] = 1, 0
        for v in order:
            for w in out[v]:
                if dist[w] < 0:
                    dist[w] = dist[v] + 1
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        load = np.zeros(n)
        for w in reversed(order):
            for v in before[w]:
                load[v] += paths[v] / paths[w] * (1 + load[w])
            if w != s:
                total[w] += load[w]
    return total / ((n - 1) * (n - 2))


def test_centrality_by_tasks_and_by_joins(spark):
    r = random.Random(7)
    n = 14
    pairs = sorted({(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(34)) if a != b} | {(i, i + 1) for i in range(n - 1)} | {(1, 0)})
    edges = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in pairs], "source string, target string")
    want = brandes([[b for x, b in pairs if x == a] for a in range(n)])
    near = graph.centrality(edges).orderBy("id").collect()
    far = graph.centrality(edges, limit=3, state=90).orderBy("id").collect()
    for rows in (near, far):
        assert [x.betweenness for x in rows] == pytest.approx(want.tolist())
    assert [x.eigenvector for x in far] == pytest.approx([x.eigenvector for x in near], abs=1e-6)
    m = np.eye(n)
    for a, b in pairs:
        m[b, a] += 1
    v = np.abs(np.linalg.eig(m)[1][:, np.argmax(np.linalg.eig(m)[0].real)].real)
    assert [x.eigenvector for x in near] == pytest.approx((v / np.linalg.norm(v)).tolist(), abs=1e-4)
    assert graph.centrality(edges.limit(0)).count() == 0


def test_late_events_are_fed_in_order(spark, tmp_path):
    """Three batches, the second with events from before the first's last; the watermark of the last releases the rest."""
    from tidemark.operators.fold import keyed_fold
    from tidemark.streaming import stateful as S

    S.ready(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    times = [[10, 11, 14, 15], [12, 13, 16, 20], [17, 40], [60]]
    frames = [spark.createDataFrame([("a", t, float(t * t % 17)) for t in ts], "k string, i long, v double").withColumn("ts", F.timestamp_seconds("i")) for ts in times]
    path = str(tmp_path / "in")
    make, out = K.RobustZ, "z double, fired boolean"

    def fed():
        stream = S.keyed_stream(S.replay(spark, path, frames[0].schema), ["k"], ["i"], make, out, ts="ts", late="5 seconds")
        q = S.to_batches(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
        assert q.awaitTermination(200)

    for f in frames:
        f.coalesce(1).write.mode("append").parquet(path)
        fed()
    got = {r.i: r.z for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    want = {r.i: r.z for r in keyed_fold(whole, ["k"], ["i"], make, out).collect()}
    assert set(range(10, 18)) <= set(got) <= set(want) and all(got[i] == pytest.approx(want[i]) for i in got)
