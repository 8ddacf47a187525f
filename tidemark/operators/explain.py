"""Which signals a risk comes from, and what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a feature's name is about (the first pattern found in it counts), and what its growth would lead to.
TOPICS = [
    ("rekey", "The interval between tunnel keys", "the tunnel may drop"),
    ("flap|adjacen", "The rate at which links and neighbours come and go", "routes may change with them"),
    ("bgp|ospf|lsa|spf|route", "Routing traffic", "paths may be recomputed"),
    ("util|queue|drop", "The load on capacity", "the link may fill up"),
    ("latency|rtt|delay", "Delay on the path", "users may notice it"),
    ("jitter|loss", "Unevenness and loss on the path", "calls and transfers may suffer"),
    ("asymmetr", "The difference between the way there and the way back", "traffic may have been rerouted"),
    ("drift|config|policy", "The distance from the intended configuration", "policy may no longer hold"),
    ("err|crc", "The count of damaged frames", "the interface may be failing"),
]
ANY_TOPIC = ("This feature", "the risk may follow")


def attribute(methods: DataFrame, key: str, risk: Column, observed: DataFrame | None = None, *, order: list[str] | None = None) -> DataFrame:
    """key, feature, value: each feature's share of the risk by weight times score of its methods.

    A method ``detector:feature`` speaks for the feature.  observed (key, feature, observation) adds
    features without a method by their magnitude.  A sum of doubles depends in its last bit on the order of its
    parts, and equal features are ranked by it: given ``order``, columns that tell a feature's methods apart, the parts
    are added in it, however the rows lie in files and tasks.
    """
    method = F.col("method")
    feature = F.when(F.instr(method, ":") > 0, F.regexp_replace(method, "^[^:]*:", "")).otherwise(method)
    part = F.col("weight") * F.col("norm")
    if order is None:
        by = methods.groupBy(key, feature.alias("feature")).agg(F.sum(part).alias("c"))
    else:
        w = Window.partitionBy(key, "feature").orderBy(*order)
        parts = methods.select(key, feature.alias("feature"), part.alias("part"), *order)
        so_far = F.sum("part").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        more = F.lead(F.lit(True), 1, False).over(w)
        by = parts.withColumns({"c": so_far, "more": more}).where("not more").select(key, "feature", "c")
    if observed is not None:
        by = by.join(observed, [key, "feature"], "full").withColumn("c", F.coalesce("c", F.abs("observation")))
    total = F.sum(F.abs("c")).over(Window.partitionBy(key).orderBy("feature").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    value = F.when(total > 0, F.col("c") * risk / total).otherwise(F.col("c"))
    return by.withColumn("value", value).drop("c")


def direction(value: Column) -> Column:
    return F.when(value > 1e-9, "increases_risk").when(value < -1e-9, "decreases_risk").otherwise("neutral")


def meaning(feature: Column, value: Column) -> Column:
    """A sentence on what the feature is about and whether it adds to the risk or takes from it."""
    low = F.lower(feature)

    def chosen(part: int) -> Column:
        out = F.lit(ANY_TOPIC[part])
        for topic in reversed(TOPICS):
            out = F.when(low.rlike(topic[0]), topic[1 + part]).otherwise(out)
        return out

    grows = F.coalesce(value, F.lit(0.0)) >= 0
    return F.when(grows, F.concat(chosen(0), F.lit(" adds to the risk: "), chosen(1), F.lit("."))).otherwise(F.concat(chosen(0), F.lit(" takes from the risk.")))


def signals(attributed: DataFrame, key: str, *, top: int = 8, least: float = 0.0) -> DataFrame:
    """The strongest features of each key with direction, meaning and rank."""
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("value")), "feature")
    ranked = attributed.where(F.abs("value") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.withColumns({"direction": direction(F.col("value")), "meaning": meaning(F.col("feature"), F.col("value"))})


def device_risk(incidents: DataFrame, blast: DataFrame) -> DataFrame:
    """node, risk: the greatest of its own incidents' risk and half that of incidents it is in the blast of.

    incidents (root, risk); blast (root, node).
    """
    spread = incidents.join(blast, "root").where("node <> root").select("node", (0.5 * F.col("risk")).alias("risk"))
    return incidents.select(F.col("root").alias("node"), "risk").unionByName(spread).groupBy("node").agg(F.max("risk").alias("risk"))


def edge_risk(edges: DataFrame, devices: DataFrame) -> DataFrame:
    """source, target, risk of undirected edges, each once: the greater of its ends'."""
    once = edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    a, b = devices.select(F.col("node").alias("source"), F.col("risk").alias("ra")), devices.select(F.col("node").alias("target"), F.col("risk").alias("rb"))
    zero = F.lit(0.0)
    return once.join(a, "source", "left").join(b, "target", "left").select("source", "target", F.greatest(F.coalesce("ra", zero), F.coalesce("rb", zero)).alias("risk"))


def permutation_importance(rows: DataFrame, predict, features: list[str], background: dict[str, list[float]], *, repeats: int = 5) -> DataFrame:
    """rows with imp_<feature>: mean fall of ``predict`` (a function of columns) when a feature takes values of a bounded background."""
    base = predict({f: F.col(f) for f in features})
    out = {}
    for f in features:
        falls = [base - predict({g: (F.lit(background[f][i % len(background[f])]) if g == f else F.col(g)) for g in features}) for i in range(repeats)]
        total = falls[0]
        for x in falls[1:]:
            total = total + x
        out[f"imp_{f}"] = F.round(total / repeats, 6)
    return rows.withColumns(out)
