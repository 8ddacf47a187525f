"""Detector banks: many detectors in one streamed pass over each series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions.models import MODELS, Discord, Pelt, Rolling
from tidemark.operators.fold import Chain, Normalized, keyed_fold

#: The detectors that run on every tick: name, family, maker.
TICK = [
    ("robust_z", "statistical", K.RobustZ),
    ("ewma_control", "statistical", K.AdaptiveChart),
    ("page_hinkley", "change_point", lambda: K.Decay(K.PageHinkley())),
    ("adwin", "change_point", lambda: K.Decay(K.Adwin())),
]


def bank(df: DataFrame, keys: list[str], order: list[str], detectors: list[tuple], value: str = "v") -> DataFrame:
    """Rows (keys, order, method, family, score, norm, fired), one for each detector and row of df."""
    out = ", ".join(f"s{i} double, n{i} double, f{i} boolean" for i in range(len(detectors)))
    makers = [m for *_, m in detectors]
    wide = keyed_fold(df, keys, order, lambda: Chain(*(Normalized(m(), K.Normalizer()) for m in makers)), out, value=value)
    rows = F.array(*(F.struct(F.lit(name).alias("method"), F.lit(family).alias("family"), F.col(f"s{i}").alias("score"), F.col(f"n{i}").alias("norm"), F.col(f"f{i}").alias("fired")) for i, (name, family, _) in enumerate(detectors)))
    return wide.select(*keys, *order, F.inline(rows))


def tick_bank(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return bank(df, keys, order, TICK)

#: The detectors that run once on the most anomalous series.
BATCH = [
    *((name, family, lambda name=name: Rolling(name)) for name, (family, *_) in MODELS.items() if name != "autoencoder"),
    ("half_space_trees", "ml_unsupervised", lambda: K.FrozenForest(warm=40, window=40)),
    ("kswin", "change_point", lambda: K.Decay(K.Kswin(seed=1337))),
    ("pelt", "change_point", Pelt),
    ("matrix_profile", "matrix_profile", Discord),
]


def batch_bank(df: DataFrame, keys: list[str], order: list[str], peaks: DataFrame, *, last: int = 120, streams: int = 12, value: str = "v") -> DataFrame:
    """The costly bank on the ``last`` values before the peak of the ``streams`` series with the greatest risk.

    peaks has keys, peak (in order[0]'s unit) and risk.
    """
    top = peaks.orderBy(F.desc("risk"), *keys).limit(streams)
    before = df.join(F.broadcast(top.select(*keys, "peak")), keys).where(F.col(order[0]) <= F.col("peak"))
    back = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    tail = before.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= last).drop("__back", "peak")
    return bank(tail, keys, order, BATCH, value=value)
