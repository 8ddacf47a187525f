"""Models over a bounded window of a series, refitted as it moves, as kernels.

A model is fitted to the lag vectors of the window and scores the newest one; the verdict needs both a
high place among past scores and a score beyond what the window itself shows.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np

from tidemark.functions.kernels import Normalizer, spread

Scorer = Callable[[np.ndarray], np.ndarray]


def lagged(xs: np.ndarray, lags: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(xs, lags) if len(xs) >= lags else xs.reshape(-1, 1)


def hbos(rows: np.ndarray, bins: int = 10, alpha: float = 0.1) -> Scorer:
    """Negative log density by equal-width histograms, one for each dimension."""
    edges, dens = [], []
    for col in rows.T:
        lo, hi = float(col.min()), float(col.max())
        e = np.linspace(lo, hi if hi > lo else lo + 1.0, bins + 1)
        h = np.histogram(col, e)[0] / len(col) / (e[1] - e[0])
        edges.append(e)
        dens.append(h)

    def score(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for col, e, h in zip(x.T, edges, dens):
            k = np.searchsorted(e, col, "right") - 1
            inside = (k >= 0) & (k < bins) | (col == e[-1])
            out -= np.log2(np.where(inside, h[np.clip(k, 0, bins - 1)], h.min()) + alpha)
        return out

    return score


def tails(rows: np.ndarray, corrected: bool) -> Scorer:
    """Sum over dimensions of the negative log of empirical tail probabilities (ECOD; COPOD with corrected=True).

    The larger of left tails, right tails and the tails on the side of each dimension's skew.
    """
    ref, n = np.sort(rows, axis=0), len(rows)
    centred = rows - rows.mean(axis=0)
    skew = np.sign((centred**3).mean(axis=0) / np.maximum((centred**2).mean(axis=0) ** 1.5, 1e-300))

    def score(x: np.ndarray) -> np.ndarray:
        m = n + 1 if corrected else n
        left = np.stack([np.searchsorted(ref[:, j], x[:, j], "right") for j in range(x.shape[1])], 1)
        right = np.stack([n - np.searchsorted(ref[:, j], x[:, j], "left") for j in range(x.shape[1])], 1)
        left, right = (-np.log(np.maximum(v, 1) / m) for v in (left, right))
        own = np.where(skew < 0, left, np.where(skew > 0, right, left + right))
        return np.maximum(np.maximum(left.sum(1), right.sum(1)), own.sum(1))

    return score


def isolation_forest(rows: np.ndarray, trees: int = 150, sample: int = 256, seed: int = 1337) -> Scorer:
    """Isolation by random cuts: 2 to the minus mean depth over expected depth.  All trees grow at once, a level at a time."""
    r = np.random.default_rng(seed)
    n, dims = min(sample, len(rows)), rows.shape[1]
    limit = max(1, math.ceil(math.log2(max(n, 2))))
    nodes = (1 << (limit + 1)) - 1

    def expected(m: np.ndarray) -> np.ndarray:
        m = np.asarray(m, float)
        return np.where(m <= 1, 0.0, np.where(m == 2, 1.0, 2 * (np.log(np.maximum(m - 1, 1)) + 0.5772156649) - 2 * (m - 1) / np.maximum(m, 1)))

    x = rows[r.random((trees, len(rows))).argsort(axis=1)[:, :n]].reshape(-1, dims)
    first = np.arange(trees) * nodes
    at = np.repeat(first, n)  # the node of each sampled row
    feature, cut = np.full(trees * nodes, -1), np.zeros(trees * nodes)
    depth = np.repeat(np.floor(np.log2(np.arange(nodes) + 1))[None], trees, axis=0).ravel()
    for _ in range(limit):
        lo, hi = np.full((trees * nodes, dims), np.inf), np.full((trees * nodes, dims), -np.inf)
        np.minimum.at(lo, at, x)
        np.maximum.at(hi, at, x)
        here = np.unique(at)
        here = here[(feature[here] < 0) & (hi[here] > lo[here]).any(axis=1)]
        chance = np.where(hi[here] > lo[here], r.random((len(here), dims)), -1.0)
        feature[here] = f = chance.argmax(axis=1)
        cut[here] = lo[here, f] + r.random(len(here)) * (hi[here, f] - lo[here, f])
        moves = np.isin(at, here)
        node = at[moves]
        base = node // nodes * nodes
        at[moves] = base + 2 * (node - base) + 1 + (x[moves, feature[node]] >= cut[node])
    # A leaf's depth, and what a tree of its rows would add.
    depth += expected(np.bincount(at, minlength=trees * nodes))
    norm = float(expected(n)) or 1.0

    def score(v: np.ndarray) -> np.ndarray:
        node = np.repeat(first[None], len(v), axis=0)
        row = np.arange(len(v))[:, None]
        for _ in range(limit):
            f = feature[node]
            down = first + 2 * (node - first) + 1 + (v[row, f] >= cut[node])
            node = np.where(f >= 0, down, node)
        return 2 ** -(depth[node].mean(axis=1) / norm)

    return score


def lof(rows: np.ndarray, k: int = 20) -> Scorer:
    """Local outlier factor of new points among the fitted ones."""
    k = max(1, min(k, len(rows) - 1))
    d = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    reach = np.take_along_axis(d, near, 1)
    kth = reach[:, -1]
    density = 1 / (np.maximum(reach, kth[near]).mean(1) + 1e-10)

    def score(x: np.ndarray) -> np.ndarray:
        e = np.sqrt(((x[:, None] - rows[None]) ** 2).sum(-1))
        at = np.argsort(e, axis=1, kind="stable")[:, :k]
        own = 1 / (np.maximum(np.take_along_axis(e, at, 1), kth[at]).mean(1) + 1e-10)
        return density[at].mean(1) / own

    return score


def pca(rows: np.ndarray, components: int = 3) -> Scorer:
    """What the first principal components leave of a standardised lag vector."""
    mean, sd = rows.mean(0), rows.std(0)
    sd = np.where(sd > 1e-12, sd, 1.0)
    axes = np.linalg.svd((rows - mean) / sd, full_matrices=False)[2][: min(components, rows.shape[1])]

    def score(x: np.ndarray) -> np.ndarray:
        z = (x - mean) / sd
        return np.linalg.norm(z - z @ axes.T @ axes, axis=1)

    return score


#: name: family, maker of a scorer, lags
MODELS: dict[str, tuple[str, Callable[[np.ndarray], Scorer], int]] = {
    "hbos": ("statistical", hbos, 1),
    "copod": ("statistical", lambda x: tails(x, True), 1),
    "ecod": ("statistical", lambda x: tails(x, False), 1),
    "isolation_forest": ("ml_unsupervised", isolation_forest, 4),
    "lof": ("ml_unsupervised", lof, 4),
    "pca_reconstruction": ("deep", pca, 8),
    # Without a library of neural networks the reconstruction is linear: the best that an autoencoder of one layer learns.
    "autoencoder": ("deep", pca, 8),
}


class Rolling:
    """A model refitted every ``refit`` values to the last ``window``; before it exists, the robust z."""

    def __init__(self, name: str, window: int = 120, refit: int = 20, place: float = 0.9):
        self.name, self.refit, self.place = name, refit, place
        self.buffer: deque[float] = deque(maxlen=window)
        self.normalizer, self.since, self.fitted, self.cut = Normalizer(), 0, None, None

    def _scorer(self) -> Scorer:
        return MODELS[self.name][1](self.fitted)

    def step(self, x, t=None):
        lags = MODELS[self.name][2]
        self.buffer.append(x)
        self.since += 1
        xs = np.array(self.buffer)
        if (self.fitted is None or self.since >= self.refit) and len(xs) >= max(10, lags + 5):
            self.fitted, self.since = lagged(xs, lags).copy(), 0
            self.live = self._scorer()
            seen = self.live(self.fitted)
            centre, scale = spread(seen)
            self.cut = float(max(np.quantile(seen, 0.99), centre + 4 * (scale or float(seen.std()) or 1.0)))
        if self.fitted is not None:
            if getattr(self, "live", None) is None:
                self.live = self._scorer()
            raw = float(self.live(xs[-lags:].reshape(1, -1))[0])
        else:
            centre, scale = spread(xs)
            raw = abs(x - centre) / scale if len(xs) >= 5 and scale > 1e-12 else 0.0
        norm = self.normalizer.add(raw)
        return raw, norm >= self.place and (self.cut is None or raw >= self.cut)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "live"}  # closures are rebuilt from what was fitted


def pelt(xs: np.ndarray, penalty: float = 8.0, least: int = 5) -> list[int]:
    """Change points of the mean by pruned exact search with squared cost."""
    n = len(xs)
    s, q = np.concatenate(([0.0], np.cumsum(xs))), np.concatenate(([0.0], np.cumsum(xs * xs)))
    best, before, alive = np.full(n + 1, np.inf), np.zeros(n + 1, int), [0]
    best[0] = -penalty
    for t in range(least, n + 1):
        starts = np.array([a for a in alive if t - a >= least])
        if not len(starts):
            continue
        m = t - starts
        cost = q[t] - q[starts] - (s[t] - s[starts]) ** 2 / m
        total = best[starts] + cost + penalty
        k = int(np.argmin(total))
        best[t], before[t] = total[k], starts[k]
        keep = set(starts[total - penalty <= best[t]].tolist())
        alive = [a for a in alive if t - a < least or a in keep] + [t - least + 1]
        alive = sorted(set(alive))
    out, t = [], n
    while t > 0 and before[t] > 0:
        out.append(int(before[t]))
        t = before[t]
    return out[::-1]


def _gain(xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of values and of their squares."""
    return np.concatenate(([0.0], np.cumsum(xs))), np.concatenate(([0.0], np.cumsum(xs * xs)))


def binary_segmentation(xs: np.ndarray, penalty: float = 8.0, least: int = 5) -> list[int]:
    """Change points by splitting the stretch where a split saves most squared error, as long as it saves more than the penalty."""
    s, q = _gain(xs)
    cost = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)

    def best(a: int, b: int) -> tuple[float, int]:
        at = np.arange(a + least, b - least + 1)
        if not len(at):
            return -np.inf, a
        saved = cost(a, b) - cost(a, at) - cost(at, b)
        k = int(np.argmax(saved))
        return float(saved[k]), int(at[k])

    stretches, out = [(*best(0, len(xs)), 0, len(xs))], []
    while stretches:
        stretches.sort()
        saved, at, a, b = stretches.pop()
        if saved <= penalty:
            break
        out.append(at)
        stretches += [(*best(a, at), a, at), (*best(at, b), at, b)]
    return sorted(out)


def window_search(xs: np.ndarray, penalty: float = 8.0, width: int | None = None) -> list[int]:
    """Change points where two neighbouring windows differ most, and by more than the penalty."""
    half = max(2, (width or max(10, len(xs) // 6)) // 2)
    s, q = _gain(xs)
    cost = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
    at = np.arange(half, len(xs) - half + 1)
    saved = cost(at - half, at + half) - cost(at - half, at) - cost(at, at + half)
    near = [saved[max(0, i - half) : i + half + 1].max() for i in range(len(at))]
    return [int(t) for t, v, top in zip(at, saved, near) if v > penalty and v >= top]


SEARCHES = {"pelt": pelt, "binseg": binary_segmentation, "window": window_search}


class Pelt:
    """A pulse when the newest fifth of the window holds a change point; looked for every ``every`` values."""

    def __init__(self, window: int = 120, every: int = 15, recent: float = 0.2, penalty: float = 8.0, decay: float = 0.6, search: str = "pelt"):
        self.search, self.buffer, self.every, self.recent, self.penalty, self.decay = search, deque(maxlen=window), every, recent, penalty, decay
        self.since, self.pulse = 0, 0.0

    def step(self, x, t=None):
        self.buffer.append(x)
        self.since += 1
        changed = False
        if self.since >= self.every:
            self.since = 0
            if len(self.buffer) >= 20:
                xs = np.array(self.buffer)
                changed = any(b >= len(xs) * (1 - self.recent) for b in SEARCHES[self.search](xs, self.penalty))
        self.pulse = 1.0 if changed else self.pulse * self.decay
        return self.pulse, changed or self.pulse >= 0.5


class Discord:
    """Distance of the newest subsequence to its nearest earlier one that doesn't overlap, both z-normalised."""

    def __init__(self, m: int = 12, window: int = 200, k: float = 3.0):
        self.m, self.k, self.buffer, self.past = m, k, deque(maxlen=window), deque(maxlen=window)

    def step(self, x, t=None):
        self.buffer.append(x)
        m, xs = self.m, np.array(self.buffer)
        if len(xs) < 4 * m:
            return 0.0, False
        w = lagged(xs, m)
        sd = w.std(1)
        z = np.where(sd[:, None] > 1e-12, (w - w.mean(1, keepdims=True)) / np.where(sd > 1e-12, sd, 1.0)[:, None], 0.0)
        d = float(np.sqrt(((z[:-m] - z[-1]) ** 2).sum(1)).min())
        fired = False
        if len(self.past) >= 8:
            centre, scale = spread(np.array(self.past))
            fired = d > centre + self.k * max(scale, 1e-9)
        self.past.append(d)
        return d, fired


def _quantile(x: np.ndarray, q: float) -> float:
    """np.quantile of a few values, without what it takes to call it."""
    x = np.sort(x)
    place = (len(x) - 1) * q
    i = int(place)
    part, a, b = place - i, x[i], x[min(i + 1, len(x) - 1)]
    return float("nan") if x[-1] != x[-1] else float(b - (b - a) * (1 - part) if part >= 0.5 else a + (b - a) * part)


def boosted(rows: np.ndarray, target: np.ndarray, rounds: int = 60, depth: int = 2, rate: float = 0.1, quantile: float | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """Gradient-boosted regression trees, squared loss or the pinball loss of a quantile."""
    start = float(np.quantile(target, quantile)) if quantile else float(target.mean())
    pred, trees = np.full(len(target), start), []

    def leaf(at):
        rest = target[at] - pred[at]
        return _quantile(rest, quantile) if quantile else float(rest.mean())

    columns = np.arange(rows.shape[1])[:, None]
    # Rows in the order of each feature, sorted once: what is left of it after a split is in order, too.
    sorted_ = np.argsort(rows, axis=0, kind="stable").T

    def grow(at, orders, grad, d):
        if not d or len(at) < 10:
            return leaf(at)
        v, c = rows[orders, columns], np.cumsum(grad[orders], axis=1)
        n = np.arange(1, len(at))
        gain = np.where(v[:, 1:] > v[:, :-1], c[:, :-1] ** 2 / n + (c[:, -1:] - c[:, :-1]) ** 2 / (len(at) - n), -np.inf)
        gain[:, :4] = gain[:, -4:] = -np.inf
        ks = gain.argmax(1)
        most = gain[columns[:, 0], ks]
        most[~np.isfinite(most)] = -np.inf
        j = int(most.argmax())
        if most[j] == -np.inf:
            return leaf(at)
        cut = (v[j, ks[j]] + v[j, ks[j] + 1]) / 2
        low = rows[:, j] <= cut
        under = low[orders]
        first, second = at[low[at]], at[~low[at]]
        return (j, cut, grow(first, orders[under].reshape(len(orders), -1), grad, d - 1), grow(second, orders[~under].reshape(len(orders), -1), grad, d - 1))

    def apply(node, x):
        if not isinstance(node, tuple):
            return np.full(len(x), node)
        low = x[:, node[0]] <= node[1]
        out = np.empty(len(x))
        out[low], out[~low] = apply(node[2], x[low]), apply(node[3], x[~low])
        return out

    for _ in range(rounds):
        rest = target - pred
        grad = np.where(rest > 0, quantile, quantile - 1) if quantile else rest
        tree = grow(np.arange(len(target)), sorted_, grad, depth)
        trees.append(tree)
        pred = pred + rate * apply(tree, rows)
    return lambda x: start + rate * sum((apply(t, x) for t in trees), np.zeros(len(x)))


def boosted_forecast(xs: np.ndarray, steps: int, lags: int = 6, roll: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Point, lower and upper trajectories from lags and rolling mean and deviation, each step fed back."""

    def feature(h: np.ndarray) -> np.ndarray:
        w = h[-roll:]
        return np.concatenate((h[-lags:], [w.mean(), w.std()]))

    first = max(lags, roll)
    if len(xs) < first + 10:
        flat = np.full(steps, float(xs[-1]))
        return flat, flat, flat
    rows, target = np.stack([feature(xs[:i]) for i in range(first, len(xs))]), xs[first:]
    out = []
    for q in (None, 0.1, 0.9):
        model, h = boosted(rows, target, quantile=q), xs.copy()
        for _ in range(steps):
            h = np.append(h, model(feature(h).reshape(1, -1))[0])
        out.append(h[len(xs) :])
    point, lo, hi = out
    return point, np.minimum(lo, point), np.maximum(hi, point)


def cox_fit(x: np.ndarray, time: np.ndarray, event: np.ndarray, ridge: float = 0.1, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportional hazards by Newton steps on the partial likelihood: coefficients, and times with the baseline's cumulative hazard."""
    order = np.argsort(-time, kind="stable")
    x, time, event = x[order], time[order], event[order].astype(bool)
    centre = x.mean(0)
    x = x - centre
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        w = np.exp(np.clip(x @ beta, -30, 30))
        s0 = np.cumsum(w)
        s1 = np.cumsum(w[:, None] * x, 0)
        s2 = np.cumsum(w[:, None, None] * x[:, :, None] * x[:, None, :], 0)
        last = np.searchsorted(-time, -time, "right") - 1  # ties share the risk set
        m = s1[last] / s0[last, None]
        grad = (x - m)[event].sum(0) - ridge * beta
        hess = (s2[last] / s0[last, None, None] - m[:, :, None] * m[:, None, :])[event].sum(0) + ridge * np.eye(len(beta))
        move = np.linalg.solve(hess, grad)
        beta = beta + move
        if np.abs(move).max() < 1e-9:
            break
    w = np.exp(np.clip(x @ beta, -30, 30))
    s0 = np.cumsum(w)
    last = np.searchsorted(-time, -time, "right") - 1
    rise = np.where(event, 1 / s0[last], 0.0)
    return beta, time[::-1], np.cumsum(rise[::-1])


def cox_expected(beta: np.ndarray, times: np.ndarray, hazard: np.ndarray, x: np.ndarray, centre: np.ndarray) -> float:
    """Expected time until the event: the area under the survival curve as far as it was seen."""
    s = np.exp(-hazard * math.exp(float(np.clip((x - centre) @ beta, -30, 30))))
    t = np.concatenate(([0.0], times))
    return float((np.concatenate(([1.0], s))[:-1] * np.diff(t)).sum())
