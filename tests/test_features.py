from __future__ import annotations

import pytest

from tidemark.operators.features import EntityEngine, Rekey, Registry, Spec, default_registry, feature_vectors
from tidemark.functions import kernels as K


def test_snapshot_is_sticky_and_keys_match(spark):
    rows = [(i, i, float(i), "e", "latency_ms" if i % 2 else "if_util_pct", 10.0 + 2 * i) for i in range(60)]
    out = feature_vectors(spark.createDataFrame(rows, "us long, seq long, t double, entity string, metric string, value double")).orderBy("us").collect()
    last = out[-1].features
    assert {"util_slope", "util_eta_seconds", "util_eta_seconds_level", "latency_drift", "latency_drift_level", "latency_eta_seconds"} <= set(last)
    assert last["util_slope"] == pytest.approx(4) and out[-1].n == 60 and out[0].features.keys() == {"util_eta_seconds_level"}


def test_throttle_loses_triggers():
    class Always:
        def step(self, x, t=None):
            return (True,)

    e = EntityEngine(Registry().add("m", Spec(Always, detector="d")), every=10.0)
    assert [e.step(1.0, t, "m")[1] for t in (0.0, 5.0, 10.0)] == [["d:m"], None, ["d:m"]]


def test_rekey_off_a_flat_baseline():
    k = Rekey()
    assert [k.step(3600.0)[0] for _ in range(30)][-1] == 0.0 and k.step(60.0)[0] > 90


def test_step_in_utilisation_fires():
    e = EntityEngine(default_registry(), trees=True)
    fired = [f for i in range(120) for f in e.step(20.0 if i < 60 else 80.0, float(i), "if_util_pct")[1]]
    assert "page_hinkley:if_util_pct" in fired and 0 <= e.snapshot["hst_score"] <= 1
    assert isinstance(next(iter(e.kernels.values())), K.Slope)
