"""Cheap screens before costly steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import MAD_SCALE, quantile


def excursions(df: DataFrame, key: str, value: str, order: list[str], *, threshold: float, above: bool = True, least: int = 12, z: float = 6.0, accuracy: int | None = None) -> DataFrame:
    """key, genuine: whether a series left the baseline of its first third, or came half way to its threshold.

    accuracy bounds the memory of long series.  above=False: for a breach from above, coming within 1.2 times the threshold counts.
    """
    w = Window.partitionBy(key).orderBy(*order)
    numbered = df.select(key, F.col(value).alias("x"), F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    head = F.when(F.col("i") <= F.greatest(F.lit(5), F.floor(F.col("n") / 3)), F.col("x"))
    base = numbered.groupBy(key).agg(F.max("n").alias("n"), quantile(head, 0.5, accuracy).alias("centre"), F.max("x").alias("hi"), F.min("x").alias("lo"))
    off = numbered.withColumn("head", head).join(base.select(key, "centre"), key).groupBy(key).agg((quantile(F.abs(F.col("head") - F.col("centre")), 0.5, accuracy) * MAD_SCALE).alias("scale"))
    peak = F.col("hi") if above else F.col("lo")
    gap = F.abs(peak - F.col("centre"))
    left = (gap / F.greatest(F.col("scale"), F.lit(1e-9)) >= z) & (gap >= 0.5 * threshold)
    near = (peak >= 0.5 * threshold) if above else (peak <= 1.2 * threshold)
    return base.join(off, key).select(key, ((F.col("n") >= least) & (left | near)).alias("genuine"))
