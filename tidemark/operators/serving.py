"""What an operator's screen asks for: timelines, the coloured topology, the incident of a question, its answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import text as X
from tidemark.operators.explain import device_risk, edge_risk

# Words of a question that speak for an issue.
KEYWORDS = {
    "bgp_route_flap": ("bgp", "flap", "peer", "route"),
    "tunnel_degradation": ("tunnel", "ipsec", "rekey", "underlay", "mpls", "lsp"),
    "interface_congestion": ("congest", "util", "uplink", "saturat", "qos", "queue"),
}


def timeline(risks: DataFrame, entity: str, *, threshold: float = 0.7, band: float = 0.05) -> DataFrame:
    """us, risk, lower, upper, breach (the first point at or over the threshold) of an entity.

    An entity without points is shown by the first of the same device that has some.
    """
    device = ":".join(entity.split(":")[:2])
    same = risks.where((F.col("entity") == entity) | F.col("entity").startswith(device + ":"))
    shown = same.agg(F.coalesce(F.max(F.when(F.col("entity") == entity, F.col("entity"))), F.min("entity")).alias("shown"))
    pts = same.join(shown, F.col("entity") == F.col("shown")).groupBy("us").agg(F.max("risk").alias("risk"))
    first = pts.agg(F.min(F.when(F.col("risk") >= threshold, F.col("us"))).alias("breach_us"))
    cut = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4)
    return pts.join(F.broadcast(first), how="left", on=F.lit(True)).select("us", F.round("risk", 4).alias("risk"), cut(F.col("risk") - band).alias("lower"), cut(F.col("risk") + band).alias("upper"), F.coalesce(F.col("us") == F.col("breach_us"), F.lit(False)).alias("breach"))


def coloured(incidents: DataFrame, blast: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and undirected edges with the risk that they are in."""
    d = device_risk(incidents, blast)
    return nodes.join(d.withColumnRenamed("node", "id"), "id", "left").withColumn("risk", F.coalesce("risk", F.lit(0.0))), edge_risk(edges, d)


def resolve(questions: DataFrame, incidents: DataFrame) -> DataFrame:
    """qid, incident: by reference, else by an entity that is the root, else by a keyword of the issue, else the headline.

    questions (qid, ref, entities, query); incidents (incident, root, issue, rank).
    """
    q = F.lower(F.coalesce("query", F.lit("")))
    words = F.create_map(*(F.lit(x) for k, v in KEYWORDS.items() for x in (k, "|".join(v))))
    by_ref = questions.join(incidents, F.col("ref") == F.col("incident")).select("qid", "incident", "rank", F.lit(0).alias("how"))
    by_root = questions.select("qid", F.explode("entities").alias("root")).join(incidents, "root").select("qid", "incident", "rank", F.lit(1).alias("how"))
    issues = questions.select("qid", q.alias("q"), F.explode(F.map_keys(words)).alias("issue"))
    asked = issues.where(F.expr("rlike(q, element_at(map(%s), issue))" % ", ".join(f"'{k}', '{'|'.join(v)}'" for k, v in KEYWORDS.items())))
    by_word = asked.join(incidents, "issue").select("qid", "incident", "rank", F.lit(2).alias("how"))
    head = incidents.where("rank = 1").select("incident", "rank")
    rest = questions.select("qid", F.lit(1).alias("rank")).join(head, "rank").select("qid", "incident", "rank", F.lit(3).alias("how"))
    ranked = by_ref.unionByName(by_root).unionByName(by_word).unionByName(rest)
    w = Window.partitionBy("qid").orderBy("how", "rank", "incident")
    return ranked.withColumn("n", F.row_number().over(w)).where("n = 1").select("qid", "incident", "how")


def tag(labels: DataFrame, incidents: DataFrame) -> DataFrame:
    """incident, scenario: the first label (by seq) one of whose nodes the incident holds.

    labels (seq, scenario, node); incidents (incident, nodes).
    """
    hit = incidents.select("incident", F.explode("nodes").alias("node")).join(labels, "node")
    return hit.groupBy("incident").agg(F.min_by("scenario", "seq").alias("scenario"))


def retrieve(docs: DataFrame, questions: DataFrame, key: str, text: str, *, k: int = 5, pool: int = 50, allowed: DataFrame | None = None) -> DataFrame:
    """qid, key, rank, score: sparse and dense rankings, each cut to its pool before the filter, fused by reciprocal ranks.

    The score shown falls evenly from 1 with the rank.  allowed: keys that pass a metadata filter.
    """
    sparse, dense = (search(docs, questions.select("qid", "query"), key, text, "qid", "query", pool) for search in (X.bm25_search, X.tfidf_search))

    def passed(r: DataFrame) -> DataFrame:
        if allowed is None:
            return r
        left = r.join(allowed, key, "left_semi")
        return left.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))

    fused = X.rrf([passed(sparse), passed(dense)], "qid", key).withColumn("score", F.round("score", 9))
    return X.rerank(X.top(fused, "qid", key, k), "qid")


def facts(reached: DataFrame, *, most: int = 2) -> DataFrame:
    """root, fact: what lies within ``most`` hops of each device, as sentences."""
    near = reached.where((F.col("hops") > 0) & (F.col("hops") <= most)).groupBy("root", "hops").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("ids"))
    return near.select("root", "hops", F.format_string("%s reaches %s within %d hop(s)", "root", "ids", "hops").alias("fact"))


def prompt(analytics: DataFrame) -> DataFrame:
    """id, prompt: sections in order, each under its name, empty ones left out."""
    names = [c for c in analytics.columns if c != "id"]
    parts = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"## {c}\n"), F.col(c))) for c in names]
    return analytics.select("id", F.array_join(F.array_compact(F.array(*parts)), "\n\n").alias("prompt"))


def summary(evaluation: DataFrame) -> DataFrame:
    """One JSON object per scenario, and whether all were detected."""
    rows = evaluation.select("scenario", F.to_json(F.struct("scenario", "detected", "lead_s", "peak")).alias("json"), "detected")
    return rows.withColumn("all_detected", F.min("detected").over(Window.partitionBy()))
