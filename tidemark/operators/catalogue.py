"""The methods of the engine as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Families in order, and their methods; a star marks one that is costly.
FAMILIES = ("forecasting", "statistical-anomaly", "ml-anomaly", "deep-anomaly", "changepoint", "matrixprofile", "graph", "survival", "fusion", "streaming")
METHODS = {
    "forecasting": "ewma_holt holt_winters theta stl_ets online_arima gbm_lag* chronos_bolt* forecast_ensemble trajectory_crossing theil_sen_extrapolation",
    "survival": "cox_survival*",
    "statistical-anomaly": "robust_z ewma_control hbos* copod* ecod*",
    "ml-anomaly": "half_space_trees* isolation_forest* lof* forecast_residual pca_recon*",
    "changepoint": "page_hinkley* adwin* kswin* ruptures_pelt*",
    "matrixprofile": "matrix_profile*",
    "deep-anomaly": "autoencoder*",
    "fusion": "weighted_agreement_fusion score_unification evt_spot_threshold probability_calibration*",
    "streaming": "adwin_stream* page_hinkley_stream* kswin_stream* cusum_stream ewma_control_chart_stream half_space_trees_stream* ddsketch_quantile* matrix_profile_stream* count_min_sketch hyperloglog",
    "graph": "correlation_graph centrality_shift",
}


def methods(spark: SparkSession, *, family: str | None = None, light: bool = False) -> DataFrame:
    """name, family, heavy; of one family, and without the costly ones, if asked."""
    rows = [(m.rstrip("*"), f, m.endswith("*")) for f, ms in METHODS.items() for m in ms.split()]
    df = spark.createDataFrame(rows, "name string, family string, heavy boolean")
    if family is not None:
        df = df.where(F.col("family") == family)
    return df.where(~F.col("heavy")) if light else df


def count_by_family(listed: DataFrame) -> DataFrame:
    """family, n in the order of FAMILIES, zeros kept."""
    all_ = listed.sparkSession.createDataFrame(list(enumerate(FAMILIES)), "seq int, family string")
    n = listed.groupBy("family").agg(F.count("*").alias("n"))
    return all_.join(n, "family", "left").select("seq", "family", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
