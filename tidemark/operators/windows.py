"""Operators on windows of keyed series: everything Spark's window functions can say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.columns import MAD_SCALE, clip, deviations, logistic, median


def series(*keys: str, order: tuple[str, ...] = ("us", "seq")) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def counter_rate(value: Column, seconds: Column, w: WindowSpec) -> Column:
    """Change per second of a counter; a fall is a restart and counts from 0; null for the first value."""
    delta, gap = value - F.lag(value).over(w), seconds - F.lag(seconds).over(w)
    return F.when(gap > 0, F.when(delta < 0, value).otherwise(delta) / gap)


def running_moments(value: str, w: WindowSpec) -> tuple[Column, Column]:
    """Mean and sample variance of all values so far."""
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.avg(value).over(upto), F.var_samp(value).over(upto)


def rolling_median(values: Column, n: int, w: WindowSpec) -> tuple[Column, Column, Column]:
    """Values of the n rows before, their median and scaled MAD."""
    before = F.collect_list(values).over(w.rowsBetween(-n, -1))
    centre = median(before)
    return before, centre, median(deviations(before, centre)) * MAD_SCALE


def robust_z(df: DataFrame, w: WindowSpec, value: str = "v", *, window: int = 50, least: int = 5) -> DataFrame:
    """df with z: distance from the median of the rows before in scaled MADs; 0 until there are five."""
    before = df.withColumn("__before", F.collect_list(value).over(w.rowsBetween(-window, -1)))
    centred = before.withColumn("__centre", median(F.col("__before")))
    scaled = centred.withColumn("__scale", median(deviations(F.col("__before"), F.col("__centre"))) * MAD_SCALE)
    x = F.col(value)
    flat = F.when(x == F.col("__centre"), 0.0).otherwise(6.0)
    z = F.when(F.size("__before") < least, 0.0).when(F.col("__scale") > 1e-12, F.abs(x - F.col("__centre")) / F.col("__scale")).otherwise(flat)
    return scaled.withColumn("z", z).drop("__before", "__centre", "__scale")


def normalized(df: DataFrame, w: WindowSpec, value: str = "z", *, window: int = 200, least: int = 8) -> DataFrame:
    """df with norm: half the rank among the rows before, half the logistic of the robust z; 0 until there are eight."""
    x = F.col(value)
    before = df.withColumn("__before", F.collect_list(value).over(w.rowsBetween(-window, -1)))
    centred = before.withColumn("__centre", median(F.col("__before")))
    scaled = centred.withColumn("__scale", median(deviations(F.col("__before"), F.col("__centre"))) * MAD_SCALE)
    rank = F.size(F.filter("__before", lambda b: b <= x)) / F.size("__before")
    squashed = F.when(F.col("__scale") > 1e-12, logistic((x - F.col("__centre")) / F.col("__scale") - 2.5)).otherwise(F.when(x > F.col("__centre"), 1.0).otherwise(0.0))
    norm = F.when(F.size("__before") < least, 0.0).otherwise(clip(0.5 * rank + 0.5 * squashed))
    return scaled.withColumn("norm", norm).drop("__before", "__centre", "__scale")


def rekey_z(value: str, w: WindowSpec, *, warmup: int = 5, flat: float = 6.0) -> Column:
    """|z| against mean and deviation of all rows before; off a flat baseline at least ``flat``."""
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    n, mean, sd = F.count(value).over(before), F.avg(value).over(before), F.sqrt(F.var_samp(value).over(before))
    dev = F.abs(F.col(value) - mean)
    off = F.when(dev > 1e-9, F.greatest(F.lit(flat), dev / (F.abs(mean) + 1e-9) * 100)).otherwise(0.0)
    return F.when(n >= warmup, F.when(sd > 1e-9, dev / sd).otherwise(off))


def streak(df: DataFrame, keys: list[str], holds: Column, w: WindowSpec, name: str) -> DataFrame:
    """df with name: how many rows in a row ``holds`` has been true (gaps and islands)."""
    run = df.withColumn("__holds", holds).withColumn("__run", F.sum(F.when(F.coalesce("__holds", F.lit(False)), 0).otherwise(1)).over(w))
    return run.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "__run").orderBy("us", "seq")) - F.when(F.coalesce("__holds", F.lit(False)), 0).otherwise(1)).drop("__holds", "__run")


def sliding_count(amount: Column, keys: list[str], seconds: int, *, most: int = 1024) -> Column:
    """Sum of amount over the last ``seconds`` (the boundary counts), at most ``most``."""
    w = Window.partitionBy(*keys).orderBy("us").rangeBetween(-seconds * 1_000_000, 0)
    return F.least(F.sum(amount).over(w), F.lit(most))


def pulse(fired: Column, w: WindowSpec, *, decay: float = 0.6) -> Column:
    """1 where a detector fires, fading by ``decay`` each row after; 0 before it ever has."""
    n = F.row_number().over(w)
    last = F.last(F.when(fired, n), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.pow(F.lit(decay), n - last), F.lit(0.0))


def sticky(df: DataFrame, keys: list[str], w: WindowSpec, features: list[str]) -> DataFrame:
    """The feature snapshot of each row: the last value of each feature that was not null, as a map without nulls."""
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    entries = F.array(*(F.struct(F.lit(f).alias("key"), F.last(f, ignorenulls=True).over(upto).alias("value")) for f in features))
    return df.withColumn("features", F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull())))


def top_talker_churn(flows: DataFrame, window: Column, key: str, weight: str, *, k: int = 10) -> DataFrame:
    """window, churn: Jaccard distance of each window's k heaviest keys from the window's before."""
    sums = flows.groupBy(window.alias("window"), F.col(key).alias("key")).agg(F.sum(weight).alias("w"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("window").orderBy(F.desc("w"), "key"))).where(F.col("rank") <= k)
    tops = ranked.groupBy("window").agg(F.collect_set("key").alias("top"))
    before = tops.withColumn("before", F.lag("top").over(Window.orderBy("window")))
    churn = 1 - F.size(F.array_intersect("top", "before")) / F.size(F.array_union("top", "before"))
    return before.select("window", churn.alias("churn"))
