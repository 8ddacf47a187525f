"""Mergeable sketches as plain aggregations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_quantiles(df: DataFrame, key: str, value: str, qs: list[float], *, accuracy: float = 0.01) -> DataFrame:
    """Quantiles with relative error ``accuracy``: rows are counted per logarithmic bucket before anything is ordered."""
    gamma = (1 + accuracy) / (1 - accuracy)
    bucket = F.ceil(F.log(F.greatest(F.col(value), F.lit(1e-9))) / math.log(gamma))
    counts = df.groupBy(key, bucket.alias("b")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key).orderBy("b")
    ranked = counts.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(key))})
    value_of = 2 * F.pow(F.lit(gamma), F.col("b")) / (gamma + 1)
    return ranked.groupBy(key).agg(*(F.min(F.when(F.col("upto") > q * (F.col("n") - 1), value_of)).alias(f"p{round(100 * q)}") for q in qs))


def distinct_sketch(df: DataFrame, key: str, value: str, *, lg: int = 12) -> DataFrame:
    """Distinct values per key, by sketches of 2**lg registers that union."""
    each = df.groupBy(key).agg(F.hll_sketch_agg(value, lg).alias("s"))
    return each.select(key, F.hll_sketch_estimate("s").alias("n"))


def count_min(df: DataFrame, key: str, *, width: int = 1024, depth: int = 4) -> DataFrame:
    """key, estimate, exact: a count-min table as (row, column) -> count, and every key looked up in it."""
    rows = F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row")
    cells = df.groupBy(key).agg(F.count("*").alias("exact")).select(key, "exact", rows).withColumn("col", F.pmod(F.xxhash64(F.col("row"), F.col(key).cast("string")), F.lit(width)))
    table = cells.groupBy("row", "col").agg(F.sum("exact").alias("cell"))
    return cells.join(table, ["row", "col"]).groupBy(key).agg(F.min("cell").alias("estimate"), F.max("exact").alias("exact"))
