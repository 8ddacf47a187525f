from __future__ import annotations

import pickle

import numpy as np
import pytest

from tidemark.functions import models as M


@pytest.mark.parametrize("name", sorted(M.MODELS))
def test_rolling_models_rank_a_spike(name):
    r = np.random.default_rng(0)
    k = M.Rolling(name)
    calm = [k.step(float(x))[0] for x in r.normal(50, 2, 140)][-40:]
    again = pickle.loads(pickle.dumps(k))
    spike = k.step(95.0)
    assert spike[0] > np.quantile(calm, 0.95) and again.step(95.0) == spike


def test_pelt_finds_steps():
    r = np.random.default_rng(1)
    xs = np.concatenate((r.normal(0, 1, 40), r.normal(8, 1, 30), r.normal(-4, 1, 50)))
    assert [abs(a - b) <= 1 for a, b in zip(M.pelt(xs, 20.0), (40, 70), strict=True)] == [True, True]
    assert M.pelt(r.normal(0, 1, 100), 20.0) == [] and M.pelt(np.array([1.0]), 20.0) == []


def test_pelt_against_plain_search():
    r = np.random.default_rng(2)
    cost = lambda x: float(((x - x.mean()) ** 2).sum())
    for _ in range(10):
        xs = np.concatenate([r.normal(m, 1, 12) for m in r.uniform(-6, 6, 4)])
        n, best = len(xs), {0: (-5.0, [])}
        for t in range(5, n + 1):
            best[t] = min(((best[a][0] + cost(xs[a:t]) + 5.0, best[a][1] + [a] * (a > 0)) for a in best if t - a >= 5), default=(np.inf, []))
        assert M.pelt(xs, 5.0) == best[n][1]


def test_discord_sees_a_strange_shape():
    wave = np.sin(np.arange(160) / 12 * 2 * np.pi)
    k = M.Discord()
    calm = [k.step(float(x))[0] for x in wave][-40:]
    odd = [k.step(float(x))[0] for x in [0, 1, -1, 1, -1, 1, -1, 1, -1, 0, 1, -1]]
    assert max(odd) > 5 * max(max(calm), 0.1)


def test_boosted_forecast():
    xs = np.tile([1.0, 5.0, 9.0, 5.0], 30)
    point, lo, hi = M.boosted_forecast(xs, 8)
    assert np.abs(point - np.tile([1.0, 5.0, 9.0, 5.0], 2)).max() < 0.5 and (lo <= point).all() and (hi >= point).all()
    assert (M.boosted_forecast(np.array([3.0, 4.0]), 3)[0] == 4.0).all()


def test_cox_recovers_a_coefficient():
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 1))
    t = r.exponential(1 / np.exp(0.8 * x[:, 0]))
    seen = t < 3
    beta, times, hazard = M.cox_fit(x, np.minimum(t, 3), seen, ridge=1e-6)
    assert beta[0] == pytest.approx(0.8, abs=0.08)
    centre = x.mean(0)
    assert M.cox_expected(beta, times, hazard, np.array([1.5]), centre) < M.cox_expected(beta, times, hazard, np.array([-1.5]), centre)


def test_scores_by_plain_versions():
    """Histograms, tails, local outliers and principal components, point by point."""
    r = np.random.default_rng(9)
    rows = np.round(r.normal(size=(60, 3)), 1)
    news = np.vstack((rows[:5], r.normal(size=(5, 3)) * 3))
    n = len(rows)
    for v in news:
        want = 0.0
        for j in range(3):
            lo, hi = rows[:, j].min(), rows[:, j].max()
            width = (hi - lo) / 10
            edges = np.linspace(lo, hi, 11)
            counts = [sum(edges[b] <= x < edges[b + 1] or (b == 9 and x == hi) for x in rows[:, j]) for b in range(10)]
            inside = [b for b in range(10) if edges[b] <= v[j] < edges[b + 1] or (b == 9 and v[j] == hi)]
            want -= np.log2((counts[inside[0]] if inside else min(counts)) / n / width + 0.1)
        assert M.hbos(rows)(v[None])[0] == pytest.approx(want)

        for corrected in (False, True):
            m = n + corrected
            left = [-np.log(max(1, sum(x <= v[j] for x in rows[:, j])) / m) for j in range(3)]
            right = [-np.log(max(1, sum(x >= v[j] for x in rows[:, j])) / m) for j in range(3)]
            skew = [((rows[:, j] - rows[:, j].mean()) ** 3).mean() for j in range(3)]
            own = sum(a if k < 0 else b if k > 0 else a + b for a, b, k in zip(left, right, skew))
            assert M.tails(rows, corrected)(v[None])[0] == pytest.approx(max(sum(left), sum(right), own))

        def nearest(p, k, but=None):
            far = sorted((float(np.linalg.norm(rows[i] - p)), i) for i in range(n) if i != but)
            return far[:k]

        def density(p, but=None):
            near = nearest(p, 8, but)
            return 1 / (np.mean([max(d, nearest(rows[i], 8, i)[-1][0]) for d, i in near]) + 1e-10), [i for _, i in near]

        own, around = density(v)
        distances = [d for d, _ in nearest(v, 9)]
        if len(set(np.round(distances, 9))) == 9:  # ties are broken by place in both, but not alike
            assert M.lof(rows, k=8)(v[None])[0] == pytest.approx(np.mean([density(rows[i], i)[0] for i in around]) / own, rel=0.05)

        z = (rows - rows.mean(0)) / rows.std(0)
        values, axes = np.linalg.eigh(z.T @ z)
        top = axes[:, np.argsort(values)[::-1][:2]]
        q = (v - rows.mean(0)) / rows.std(0)
        assert M.pca(rows, components=2)(v[None])[0] == pytest.approx(np.linalg.norm(q - top @ (top.T @ q)))


def test_boosting_sorts_each_feature_once(monkeypatch):
    """Nodes of trees take the features' order from the one before; the small quantile is numpy's."""
    calls, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **kw: calls.append(1) or sort(*a, **kw))
    xs = np.random.default_rng(2).normal(size=120)
    M.boosted_forecast(xs, 4)
    assert len(calls) == 3
    for q in (0.1, 0.5, 0.9):
        assert all(M._quantile(xs[:n], q) == np.quantile(xs[:n], q) for n in range(1, 60))
