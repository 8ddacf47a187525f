"""Fusion of detector scores into one risk, and what makes a number comparable before and after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import MAD_SCALE, clip, deviations, fold_sum, median, normal_cdf, quantile
from tidemark.functions.kernels import extreme_scores
from tidemark.functions.lineage import cut
from tidemark.operators.relational import running_total

# Weight of a detector family, and the issue that it hints at.
FAMILY_PRIOR = {
    "forecast": 1.0, "forecast_residual": 1.1, "statistical": 0.9, "ml_unsupervised": 1.0, "deep": 1.0, "change_point": 1.1,
    "matrix_profile": 1.0, "graph": 1.0, "routing": 1.1, "survival": 1.0,
}
FAMILY_ISSUE = {"change_point": "latency_drift", "matrix_profile": "latency_drift", "routing": "bgp_route_flap", "forecast": "interface_congestion"}
ELEVATED, BOOST = 0.6, 0.5


def prior(family: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in FAMILY_PRIOR.items() for x in kv))
    return F.coalesce(F.try_element_at(table, family), F.lit(1.0))


def minmax(df: DataFrame, keys: list[str], value: str, name: str = "norm") -> DataFrame:
    """df with name: the value's place between its key's least and greatest, which two partial aggregates give."""
    bounds = cut(df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")))
    width = F.col("__hi") - F.col("__lo")
    return df.join(bounds, keys, "left").withColumn(name, F.when(width < 1e-12, 0.0).otherwise(clip((F.col(value) - F.col("__lo")) / width))).drop("__lo", "__hi")


def shares(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with at_most and at_least: the shares of its key's values that are not greater, and not smaller.

    Distinct values are counted first and their counts run along a sort by ranges, so no key is one task.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    upto = cut(running_total(counts, keys, [value], F.col("__n"), "__upto"))
    total = cut(upto.groupBy(*keys).agg(F.max("__upto").alias("__total")))
    placed = df.join(upto, [*keys, value], "left").join(total, keys, "left")
    return placed.withColumns({"at_most": F.col("__upto") / F.col("__total"), "at_least": (F.col("__total") - F.col("__upto") + F.col("__n")) / F.col("__total")}).drop("__n", "__upto", "__total")


def robust_standard(df: DataFrame, keys: list[str], value: str, name: str = "z", *, accuracy: int | None = None) -> DataFrame:
    """df with name: distance from the key's median in scaled MADs, 0 where they are all alike.

    Two aggregations, no frame is gathered; accuracy bounds the memory of large groups.
    """
    centre = df.groupBy(*keys).agg(quantile(value, 0.5, accuracy).alias("__centre"))
    with_centre = df.join(centre, keys)
    scale = with_centre.groupBy(*keys).agg((quantile(F.abs(F.col(value) - F.col("__centre")), 0.5, accuracy) * MAD_SCALE).alias("__scale"))
    z = F.when(F.col("__scale") < 1e-12, 0.0).otherwise((F.col(value) - F.col("__centre")) / F.col("__scale"))
    return with_centre.join(scale, keys).withColumn(name, z).drop("__centre", "__scale")


def unify(z: Column) -> Column:
    return clip(normal_cdf(z))


def extreme(norms: Column) -> Column:
    """Array of booleans: which of a few scores stand out (median and 2.5 scaled MADs, at least half of ELEVATED)."""
    centre = median(norms)
    scale = median(deviations(norms, centre)) * MAD_SCALE
    cut = F.when(scale > 1e-9, centre + 2.5 * scale).otherwise(F.greatest(F.lit(ELEVATED), centre))
    return F.transform(norms, lambda x: x >= F.greatest(cut, F.lit(ELEVATED * 0.5)))


def extreme_of_many(norms: Column) -> Column:
    """The same where a key has six scores or more: by a drift threshold, in an Arrow function."""
    from pyspark.sql.types import ArrayType, BooleanType

    @F.pandas_udf(ArrayType(BooleanType()))
    def many(xs):
        return xs.map(lambda x: extreme_scores(x) if len(x) >= 6 else [False] * len(x))

    return F.when(F.size(norms) < 6, extreme(norms)).otherwise(many(norms))


def issue_hint(family: Column, risk: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in FAMILY_ISSUE.items() for x in kv))
    return F.when(risk > 0, F.coalesce(F.try_element_at(table, family), F.lit("none"))).otherwise("none")


def fuse(scores: DataFrame, keys: list[str], *, many: bool = False, forecast_agreement: Column | None = None, n_drift: Column | None = None) -> DataFrame:
    """One row for each key: risk, confidence, agreement, n_methods, top_family.

    scores has method, family, norm (0 to 1) and fired.  A key has as many rows as there are detectors,
    so its scores are gathered into one array and the rest is arithmetic on it.
    many: keys may have six scores or more, which are thresholded in Python.
    forecast_agreement and n_drift (columns of keys' rows, constant within a key) vote along.
    """
    extras = []
    if forecast_agreement is not None:
        extras.append(F.max(forecast_agreement).alias("fa"))
    if n_drift is not None:
        extras.append(F.max(n_drift).alias("nd"))
    row = F.struct("method", "family", clip(F.col("norm")).alias("norm"), F.col("fired"), prior(F.col("family")).alias("prior"))
    g = scores.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("s"), *extras)
    g = g.withColumn("norms", F.transform("s", lambda x: x["norm"])).withColumn("extreme", (extreme_of_many if many else extreme)(F.col("norms")))
    same = lambda f: F.size(F.filter("s", lambda y: y["family"] == f))
    weight = lambda x, e: x["prior"] / same(x["family"]) * F.when(e | x["fired"], 1 + BOOST).otherwise(1.0)
    g = g.withColumn("weights", F.zip_with("s", "extreme", weight))
    fused = fold_sum(F.zip_with("weights", "norms", lambda w, x: w * x)) / fold_sum(F.col("weights"))
    families = F.array_distinct(F.transform("s", lambda x: x["family"]))
    votes = F.transform(families, lambda f: F.array_max(F.transform(F.filter("s", lambda y: y["family"] == f), lambda y: y["norm"])))
    if forecast_agreement is not None:
        votes = F.when(F.col("fa").isNotNull(), F.concat(votes, F.array(clip(F.col("fa"))))).otherwise(votes)
    if n_drift is not None:
        votes = F.when(F.col("nd") > 0, F.concat(votes, F.array(F.least(F.lit(1.0), 0.5 + 0.1 * F.col("nd"))))).otherwise(votes)
    g = g.withColumn("votes", votes).withColumn("fused", fused)
    high = F.size(F.filter("votes", lambda v: v >= ELEVATED))
    agreement = F.when(high == 0, 0.0).otherwise(clip(high / F.size("votes") * (1 - F.exp(-0.8 * high))))
    g = g.withColumn("agreement", agreement).withColumn("risk", clip(F.col("fused") * (0.5 + 0.5 * F.col("agreement"))))
    peak = F.array_max("norms")
    conf = 0.65 * F.col("agreement") + 0.35 * peak
    conf = F.when(F.size("s") <= 1, F.least(conf, 0.5 * peak + 0.1)).otherwise(conf)
    if forecast_agreement is not None:
        conf = F.when(F.col("fa").isNotNull(), 0.85 * conf + 0.15 * clip(F.col("fa"))).otherwise(conf)
    top = F.element_at(F.filter("s", lambda x: x["norm"] == peak), 1)["family"]
    return g.select(*keys, "risk", clip(conf).alias("confidence"), "agreement", "fused", F.size("s").cast("long").alias("n_methods"), top.alias("top_family"))


def pot_threshold(df: DataFrame, key: str, value: str, *, q: float = 0.001, start: float = 0.95, accuracy: int | None = None) -> DataFrame:
    """key, base, shape, scale, level: peaks over threshold by the method of moments, in aggregations alone."""
    base = df.groupBy(key).agg(quantile(value, start, accuracy).alias("base"), F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.max(value).alias("top"))
    over = df.join(base.select(key, "base"), key).where(F.col(value) > F.col("base")).withColumn("e", F.col(value) - F.col("base"))
    tail = over.groupBy(key).agg(F.count("*").alias("nt"), F.avg("e").alias("m"), F.var_samp("e").alias("v"))
    ratio = F.col("m") * F.col("m") / F.col("v")
    plain = (F.col("v") <= 1e-12) | (F.col("m") <= 0)
    shape = F.when(plain, 0.0).otherwise(clip(0.5 * (1 - ratio), -0.5, 0.9))
    scale = F.when(plain, F.greatest("m", F.lit(1e-6))).otherwise(0.5 * F.col("m") * (ratio + 1))
    g = base.join(tail, key, "left").withColumns({"shape": shape, "scale": scale, "r": clip(q * F.col("n") / F.col("nt"), 1e-12, 1.0)})
    level = F.when(F.abs("shape") < 1e-8, F.col("base") - F.col("scale") * F.log("r")).otherwise(F.col("base") + F.col("scale") / F.col("shape") * (F.pow("r", -F.col("shape")) - 1))
    few = F.when(F.col("n") < 10, F.col("mean") + 4 * F.col("sd")).when(F.coalesce("nt", F.lit(0)) < 2, F.col("top"))
    return g.select(key, "base", "shape", "scale", F.coalesce(few, level).alias("level"))
