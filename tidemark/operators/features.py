"""The feature engine: every record moves its metric's kernels on, and its entity's snapshot is emitted."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidemark.functions import kernels as K
from tidemark.operators.fold import keyed_fold

# Service thresholds that times to impact are taken to.
THRESHOLDS = {"if_util_pct": 90.0, "latency_ms": 150.0, "jitter_ms": 30.0, "loss_pct": 2.0, "tunnel_loss_pct": 2.0, "tunnel_jitter_ms": 30.0, "queue_depth": 0.8}


@dataclass(frozen=True)
class Spec:
    """A kernel of a metric: its results by feature name, or as a detector the name that it fires under."""

    make: Callable[[], object]
    features: tuple[str | None, ...] = ()
    detector: str | None = None


@dataclass
class Registry:
    specs: dict[str, list[Spec]] = field(default_factory=dict)

    def add(self, metric: str, *specs: Spec) -> "Registry":
        self.specs.setdefault(metric, []).extend(specs)
        return self


class Rekey:
    """|z| against mean and deviation of the values before; off a flat baseline at least ``flat``."""

    def __init__(self, warmup: int = 5, flat: float = 6.0):
        self.moments, self.warmup, self.flat = K.Moments(), warmup, flat

    def step(self, x, t=None):
        m, z = self.moments, None
        if m.n >= self.warmup:
            off, sd = abs(x - m.mean), m.std()
            z = off / sd if sd > 1e-9 else max(self.flat, off / (abs(m.mean) + 1e-9) * 100) if off > 1e-9 else 0.0
        m.add(x)
        return (z,)


def default_registry(thresholds: Mapping[str, float] | None = None) -> Registry:
    th = THRESHOLDS | dict(thresholds or {})

    def eta(metric: str, key: str) -> Spec:
        return Spec(lambda: K.TimeToThreshold(th.get(metric, 100.0)), (f"{key}_level", key))

    def hinkley(limit: float) -> Spec:
        return Spec(lambda: K.PageHinkley(limit=limit), detector="page_hinkley")

    def jitter(key: str) -> list[Spec]:
        return [Spec(K.EwVariance, (key,)), Spec(K.RunningQuantile, (f"{key}_p99",))]

    def loss(key: str) -> Spec:
        return Spec(K.RisingStreak, (key, None))

    r = Registry()
    r.add("if_util_pct", Spec(K.Slope, ("util_slope",)), eta("if_util_pct", "util_eta_seconds"), hinkley(8.0))
    r.add("latency_ms", Spec(K.LevelDrift, ("latency_drift_level", "latency_drift")), hinkley(20.0), eta("latency_ms", "latency_eta_seconds"))
    r.add("jitter_ms", *jitter("jitter_ewvar"), Spec(K.Adwin, detector="adwin"))
    r.add("loss_pct", loss("loss_progression"), hinkley(3.0), eta("loss_pct", "loss_eta_seconds"))
    r.add("tunnel_loss_pct", loss("tunnel_loss_progression"), hinkley(3.0))
    r.add("tunnel_jitter_ms", *jitter("tunnel_jitter_ewvar"))
    r.add("if_in_errors", Spec(K.CounterAcceleration, ("err_accel_rate", "err_accel")))
    return r.add("tunnel_rekey_interval_s", Spec(Rekey, ("rekey_anomaly",)))


class EntityEngine:
    """All kernels of an entity and its snapshot.

    A feature keeps its last value until a new one comes.  Between emissions less than ``every``
    seconds apart nothing is emitted, and what fires meanwhile is lost.
    """

    def __init__(self, registry: Registry, every: float | None = None, trees: bool = False):
        self.registry, self.every, self.trees = registry, every, trees
        self.kernels: dict[tuple[str, int], object] = {}
        self.snapshot: dict[str, float] = {}
        self.names = sorted({f for specs in registry.specs.values() for s in specs for f in s.features if f}) if trees else []
        self.forest = K.HalfSpaceTrees(height=10, window=250, seed=42, dims=len(self.names)) if trees else None
        self.n, self.last = 0, None

    def step(self, x, t, metric):
        self.n += 1
        fired = []
        for i, spec in enumerate(self.registry.specs.get(metric, ())):
            kernel = self.kernels.get((metric, i)) or self.kernels.setdefault((metric, i), spec.make())
            out = kernel.step(x, None)
            if spec.detector:
                if out[-1]:
                    fired.append(f"{spec.detector}:{metric}")
            else:
                self.snapshot |= {k: float(v) for k, v in zip(spec.features, out) if k and v is not None and v - v == 0}
        if self.trees and self.snapshot:
            score, high = self.forest.step([self.snapshot.get(f, 0.0) for f in self.names])
            self.snapshot["hst_score"] = score
            if high:
                fired.append("half_space_trees:snapshot")
        if self.every is not None and self.last is not None and t - self.last < self.every:
            return None, None, None
        self.last = t
        return list(self.snapshot.items()), fired, self.n


def feature_vectors(telemetry: DataFrame, *, registry: Registry | None = None, every: float | None = None, trees: bool = False) -> DataFrame:
    """us, seq, entity, features, triggered, n of telemetry (us, seq, t, entity, metric, value): a vector per record."""
    reg = registry or default_registry()
    out = keyed_fold(telemetry, ["entity"], ["us", "seq"], lambda: EntityEngine(reg, every, trees), "features map<string,double>, triggered array<string>, n long", value="value", seconds="t", extra=("metric",))
    return out.where("n is not null")
