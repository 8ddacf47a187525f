"""From telemetry to a situation: scores, risk timeline, forecasts, incidents, answers, evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clip
from tidemark.functions.lineage import cut
from tidemark.operators import forecast as FC
from tidemark.operators import fusion, graph, risk
from tidemark.operators.bank import batch_bank, tick_bank
from tidemark.operators.evaluate import evaluate
from tidemark.operators.relational import map_to_node
from tidemark.plans.registry import query
from tidemark.schema import PRECURSORS


@dataclass(frozen=True)
class Settings:
    timeline_floor: float = 0.20
    incident_floor: float = 0.40
    forecast_streams: int = 10
    batch_streams: int = 12
    steps: int = 12
    step_s: float = 20.0
    alert: float = 0.30
    window_us: int = 300_000_000
    every: int = 1
    raw_events: bool = False

    def __post_init__(self):
        if min(self.forecast_streams, self.batch_streams, self.steps, self.every) < 1:
            raise ValueError("streams, steps and every must be positive")


#: What a run looks at: fast forecasts from every other point, full from all, for more streams and steps.
PROFILES = {"fast": Settings(every=2), "full": Settings(forecast_streams=40, batch_streams=40, steps=24)}


def situation(telemetry: DataFrame, nodes: DataFrame, edges: DataFrame, labels: DataFrame | None = None, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """telemetry has seq, us, entity, metric, value.

    Returns scores, timeline, peaks, forecasts, impacts, grouped events, incidents, and with labels evaluation.
    """
    s = settings
    spark = telemetry.sparkSession
    spec = F.broadcast(spark.createDataFrame(PRECURSORS, "metric string, threshold double, above boolean, issue string"))
    watched = cut(telemetry.join(spec, "metric").select("seq", "us", "entity", "metric", F.col("value").alias("v"), "threshold", "above", "issue"))
    key = ["entity", "metric"]
    scores = cut(tick_bank(watched, key, ["us", "seq"]))
    timeline = cut(fusion.fuse(scores.where("norm is not null"), [*key, "us", "seq"]))

    # A stream's peak is the first tick of its greatest score; streams that left their baseline go on.
    peak = timeline.groupBy(*key).agg(F.max_by(F.struct("us", "seq", "risk", "confidence", "agreement", "top_family"), F.struct("risk", -F.col("us"))).alias("p")).select(*key, "p.*")
    share = F.when(F.col("above"), F.max("v").over(Window.partitionBy(*key)) / F.col("threshold")).otherwise(F.col("threshold") / F.greatest(F.min("v").over(Window.partitionBy(*key)), F.lit(1e-9)))
    reach = watched.select(*key, "issue", "threshold", "above", share.alias("excursion")).groupBy(*key, "issue", "threshold", "above").agg(F.max("excursion").alias("excursion"))
    near = F.when(F.col("above"), F.col("excursion") >= 0.5).otherwise(F.col("excursion") >= 1 / 1.2)
    screened = cut(peak.join(reach, key).where(near & (F.col("risk") >= s.timeline_floor)))

    # The costly detectors look at the top streams once; at the peak their scores join those of the tick.
    extra = batch_bank(watched, key, ["us", "seq"], screened.select(*key, F.col("us").alias("peak"), "risk"), streams=s.batch_streams)
    at_peak = screened.select(*key, "us", "seq")
    all_scores = extra.unionByName(scores).join(at_peak, [*key, "us", "seq"], "left_semi").where("norm is not null")
    final = fusion.fuse(all_scores, key, many=True).select(*key, F.col("risk").alias("final_risk"), F.col("confidence").alias("final_confidence"), "n_methods")
    peaks = screened.join(final, key, "left").withColumns({"risk": F.coalesce("final_risk", "risk"), "confidence": F.coalesce("final_confidence", "confidence")}).drop("final_risk", "final_confidence")
    peaks = cut(peaks)
    best = peaks.orderBy(F.desc("risk"), *key).limit(s.forecast_streams)

    history = watched.join(best.select(*key, F.col("us").alias("peak_us")), key).where("us <= peak_us").withColumn("stream", F.concat_ws("|", *key))
    if s.every > 1:
        # Every so many points, the last one among them; a forecast's step grows along.
        back = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("us"), F.desc("seq")))
        history = history.withColumn("back", back).where((F.col("back") - 1) % s.every == 0).drop("back")
    members = FC.holt(history, "stream", ["us", "seq"], "v", s.steps).unionByName(FC.theta(history, "stream", ["us", "seq"], "v", s.steps)).unionByName(FC.holt(history, "stream", ["us", "seq"], "v", s.steps, damping=0.9, method="ewma_damped"))
    now = history.groupBy("stream", *key, "threshold", "above").agg(F.max_by("v", "us").alias("now"))
    pooled = FC.ensemble(members, ["stream"]).join(now, "stream")
    forecasts = cut(pooled)
    up = FC.crossing(forecasts.where("above"), ["stream", *key], "now", F.col("threshold"), seconds=s.step_s)
    down = FC.crossing(forecasts.where("not above"), ["stream", *key], "now", F.col("threshold"), seconds=s.step_s, above=False)
    impacts = up.unionByName(down)

    at_risk = peaks.where(F.col("risk") >= s.incident_floor).join(impacts.select(*key, "eta"), key, "left")
    collapsed = at_risk.groupBy("entity").agg(F.max_by(F.struct("metric", "us", "seq", "risk", "confidence", "issue", "eta"), F.struct("excursion", "risk")).alias("e")).select("entity", "e.*")
    placed = cut(collapsed.join(map_to_node(collapsed, nodes), "entity", "left"))
    events = placed.select("seq", "entity", F.concat(F.lit("fused|"), F.col("issue")).alias("kind"), "us", "node", F.col("risk").alias("score"), "issue", "confidence", "eta")
    if s.raw_events:
        # The detectors' own events at the peaks join those of the fused risk.
        raw = graph.normalized_events(cut(all_scores.where("fired")), peaks.select("seq", "us", "entity", "risk", "issue").limit(0)).where("issue is null")
        raw = raw.join(placed.select("entity", "node"), "entity").select("seq", "entity", "kind", "us", "node", "score", F.lit("none").alias("issue"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("double").alias("eta"))
        events = events.unionByName(raw.withColumn("seq", F.xxhash64("seq", "kind")))
    grouped = cut(graph.correlated(events, graph.within_two_hops(edges), window=s.window_us))
    groups = graph.incident_groups(grouped)

    central = graph.centrality(edges).select(F.col("id").alias("node"), ((F.col("betweenness") + F.col("eigenvector")) / 2).alias("c"))
    member = grouped.join(central, "node", "left")
    w = Window.partitionBy("component")
    spread = F.max("c").over(w) - F.min("c").over(w)
    candidates = member.select("component", "seq", "entity", "node", "issue", "score", "confidence", "eta", F.when(spread > 0, 0.05 + 0.95 * (F.col("c") - F.min("c").over(w)) / spread).otherwise(1.0).alias("centrality"), graph.onset_score(F.col("us"), w).alias("onset")).join(_influence(grouped, placed, watched), ["component", "entity"], "left").withColumn("causal", F.coalesce("causal", F.lit(1.0)))
    ranked = cut(graph.root_causes(candidates, "component", "seq"))
    root = ranked.where("rank = 1").select("component", F.col("entity").alias("root"), F.col("node").alias("root_node"), "rationale", F.col("score").alias("cause_score"))
    reached = graph.bfs(edges, root.select(F.col("root_node").alias("id")).where("id is not null").distinct())
    blast = graph.blast_radius(reached, nodes, F.lit(nodes.count()))
    dominant = member.groupBy("component", "issue").agg(F.count("*").alias("n"), F.min("seq").alias("f")).groupBy("component").agg(F.max_by("issue", F.struct("n", -F.col("f"))).alias("issue"))
    strongest = member.groupBy("component").agg(F.max_by(F.struct(F.col("score").alias("risk"), "confidence", "eta"), "score").alias("m")).select("component", "m.*")
    inc = groups.drop("rank").join(root, "component").join(dominant, "component").join(strongest, "component").join(blast.withColumnRenamed("root", "root_node"), "root_node", "left").join(nodes.select(F.col("id").alias("root_node"), "criticality"), "root_node", "left")
    inc = inc.withColumns({"blast": F.coalesce("size", F.lit(0.0)), "criticality": F.coalesce("criticality", F.lit(0.5)), "demotion": F.lit(1.0), "confidence": clip(F.col("confidence"))})
    incidents = cut(risk.prioritized(inc, seq="component"))

    out = {"scores": scores, "timeline": timeline, "peaks": peaks, "forecasts": forecasts, "impacts": impacts, "events": grouped, "candidates": ranked, "incidents": incidents, "answers": answers(incidents)}
    if labels is not None:
        risks = timeline.join(map_to_node(timeline, nodes), "entity").select("node", "us", "risk")
        out["evaluation"] = evaluate(labels.select("label", "scenario", "issue", "node", "precursor_us", "fault_us"), risks, alert=s.alert, width=s.window_us)
    return out


def _influence(grouped: DataFrame, placed: DataFrame, watched: DataFrame) -> DataFrame:
    """component, entity, causal: how much an entity's series foretells those of the others of its incident, 0.25 to 1 within it."""
    several = grouped.groupBy("component").agg(F.countDistinct("entity").alias("n")).where("n > 1")
    members = grouped.join(several, "component").select("component", "entity").distinct().join(placed.select("entity", "metric"), "entity")
    series = watched.join(members, ["entity", "metric"]).select("component", "entity", "us", "seq", "v")
    scores = cut(graph.granger_scores(series, "component", "entity", ["us", "seq"], "v"))
    w = Window.partitionBy("component")
    lo, spread = F.min("causal").over(w), F.max("causal").over(w) - F.min("causal").over(w)
    return scores.select("component", F.col("cause").alias("entity"), F.when(spread > 1e-9, 0.25 + 0.75 * (F.col("causal") - lo) / spread).otherwise(1.0).alias("causal"))


def answers(incidents: DataFrame) -> DataFrame:
    """incident, headline, answer: the template answer of each incident, from its fields alone."""
    minutes = F.bround(risk.minutes(F.col("eta")), 1)
    when = F.when(minutes.isNull(), "no threshold crossing is forecast").otherwise(F.concat(F.lit("a threshold is reached in about "), minutes.cast("string"), F.lit(" minutes")))
    head = F.format_string("%s: %s at %s", "severity", F.replace("issue", F.lit("_"), F.lit(" ")), "root")
    body = F.concat(head, F.lit(". Root cause chosen by "), F.col("rationale"), F.lit("; "), when, F.lit("; sites downstream: "), F.coalesce(F.when(F.size("sites") > 0, F.array_join(F.slice("sites", 1, 5), ", ")), F.lit("none")), F.lit("."))
    return incidents.select(F.col("component").alias("incident"), "rank", head.alias("headline"), body.alias("answer"))


@query()
def end_to_end(spark, sf_dir):
    """Four generated scenarios: was each foreseen, how early, and how strongly?"""
    from tidemark.sources import generator as g

    cfg = g.Config()
    return situation(g.telemetry(spark, cfg), g.nodes(spark), g.edges(spark), g.labels(spark, cfg))["evaluation"]


@query()
def end_to_end_incidents(spark, sf_dir):
    from tidemark.sources import generator as g

    return situation(g.telemetry(spark), g.nodes(spark), g.edges(spark))["incidents"].select("rank", "severity", "priority", "issue", "root", "n_events", "n_affected", "compression")


@query()
def feature_vectors(spark, sf_dir):
    """A feature vector for each generated record."""
    from tidemark.operators.features import feature_vectors as engine
    from tidemark.sources import generator as g

    return engine(g.telemetry(spark, g.Config()))


@query()
def feature_engine_on_events(spark, sf_dir):
    """The engine over the events of each user: clicks as utilisation, views as latency, errors as counters."""
    from tidemark.operators.features import feature_vectors as engine
    from tidemark.plans.views import telemetry

    name = F.create_map(*(F.lit(x) for x in ("click", "if_util_pct", "view", "latency_ms", "error", "if_in_errors", "signup", "loss_pct", "purchase", "jitter_ms")))
    t = telemetry(spark, sf_dir).select("us", "seq", F.col("s").alias("t"), F.col("k").cast("string").alias("entity"), F.element_at(name, F.col("metric")).alias("metric"), F.col("v").alias("value"))
    return engine(t)
