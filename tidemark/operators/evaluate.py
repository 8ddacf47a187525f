"""Evaluation against labelled faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.relational import interval_join


def evaluate(labels: DataFrame, risks: DataFrame, *, alert: float = 0.30, width: int = 300_000_000) -> DataFrame:
    """labels with detected, lead_s and peak: the first risk of ``alert`` or more on the label's node in its precursor window.

    labels (label, node, precursor_us, fault_us); risks (node, us, risk).
    """
    hits = interval_join(risks, labels.select("label", "node", "precursor_us", "fault_us"), "us", "precursor_us", "fault_us", width=width, on=["node"])
    by = hits.groupBy("label").agg(F.min(F.when(F.col("risk") >= alert, F.col("us"))).alias("first_us"), F.max("risk").alias("peak"))
    out = labels.join(by, "label", "left")
    return out.withColumns({"detected": F.col("first_us").isNotNull(), "lead_s": (F.col("fault_us") - F.col("first_us")) / 1e6, "peak": F.coalesce("peak", F.lit(0.0))})


def incident_of(labels: DataFrame, incidents: DataFrame) -> DataFrame:
    """scenario, incident: the first incident (by rank) that is tagged with the scenario, else one that holds its node, else none.

    labels (scenario, node); incidents (incident, rank, tag, nodes).
    """
    tagged = labels.join(incidents.select(F.col("tag").alias("scenario"), "incident", "rank"), "scenario").select("scenario", "incident", F.lit(0).alias("how"), "rank")
    held = labels.join(incidents.select(F.explode("nodes").alias("node"), "incident", "rank"), "node").select("scenario", "incident", F.lit(1).alias("how"), "rank")
    best = tagged.unionByName(held).groupBy("scenario").agg(F.min_by("incident", F.struct("how", "rank", "incident")).alias("incident"))
    return labels.select("scenario").distinct().join(best, "scenario", "left")
