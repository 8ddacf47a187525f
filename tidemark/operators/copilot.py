"""Answers to questions about an incident: which field counts, what is looked up, and what may be cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import written
from tidemark.operators import text as X
from tidemark.operators.serving import retrieve


def field(*sources: Column) -> Column:
    """The first that is there: what the question says, else the fused risk, else the incident."""
    return F.coalesce(*sources)


def list_field(*sources: Column) -> Column:
    """The first list that has something in it, else an empty one."""
    empty = F.slice(sources[0], 1, 0)
    return F.coalesce(*(F.when(F.size(s) > 0, s) for s in sources), F.coalesce(empty, F.array().cast("array<string>")))


def resolved(questions: DataFrame, fused: DataFrame, incidents: DataFrame) -> DataFrame:
    """questions with issue, confidence, eta_min, signals and root, by precedence.

    questions (qid, query, entity, incident, eta, signals); fused (entity, issue, confidence, eta);
    incidents (incident, issue, confidence, eta, signals, root).  eta is in seconds, eta_min in minutes.
    """
    f = fused.select("entity", F.struct("issue", "confidence", "eta").alias("f"))
    i = incidents.select("incident", F.struct("issue", "confidence", "eta", "signals", "root").alias("i"))
    q = questions.withColumnRenamed("eta", "own_eta").withColumnRenamed("signals", "own_signals").join(f, "entity", "left").join(i, "incident", "left")
    eta = field(F.col("own_eta"), F.col("f.eta"), F.col("i.eta"))
    return q.select(
        "qid", "query", "entity", "incident", field(F.col("f.issue"), F.col("i.issue"), F.lit("none")).alias("issue"), field(F.col("f.confidence"), F.col("i.confidence"), F.lit(0.0)).alias("confidence"),
        F.bround(eta / 60, 1).alias("eta_min"), list_field(F.col("own_signals"), F.col("i.signals")).alias("signals"), F.col("i.root").alias("root"),
    )


def search_text(query: Column, issue: Column, signals: Column, *, most: int = 5) -> Column:
    """What is looked up: the question, the issue in words and the first signals; a standing question if there is nothing."""
    parts = F.concat(F.array(F.when(query != "", query), F.when(issue != "none", F.replace(issue, F.lit("_"), F.lit(" ")))), F.slice(signals, 1, most))
    joined = F.array_join(F.array_compact(parts), " ")
    return F.when(joined == "", "runbook for an incident of the network").otherwise(joined)


def answers(questions: DataFrame, fused: DataFrame, incidents: DataFrame, corpus: DataFrame, *, k: int = 5) -> DataFrame:
    """qid, issue, confidence, eta_min, answer, cited, dropped, abstains, grounding of each question.

    corpus (chunk_id, text).  Fields come by precedence; the question, issue and signals look up k chunks; the answer
    says what is known in one sentence and cites the chunks; its grounding is the share of its words that they hold;
    citations outside of what was found are dropped, and without one the answer abstains.
    """
    q = resolved(questions, fused, incidents).withColumn("search", search_text(F.coalesce("query", F.lit("")), F.col("issue"), F.col("signals")))
    found = written(retrieve(corpus, q.select("qid", F.col("search").alias("query")), "chunk_id", "text", k=k))  # its size is known: small, it goes to the corpus, which is not shuffled
    held = found.join(corpus, "chunk_id").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))), lambda r: r).alias("found"))
    known = q.join(held, "qid", "left").withColumn("universe", F.coalesce(F.transform("found", lambda r: r["chunk_id"].cast("string")), F.array().cast("array<string>")))
    context = F.coalesce(F.array_join(F.transform("found", lambda r: r["text"]), "\n"), F.lit(""))
    issue = F.replace("issue", F.lit("_"), F.lit(" "))
    when = F.when(F.col("eta_min").isNotNull(), F.format_string("impact in %.1f minutes", "eta_min")).otherwise("no impact foreseen")
    said = F.concat_ws(", ", F.concat(F.initcap(issue), F.coalesce(F.concat(F.lit(" at "), "root"), F.lit(""))), when)
    gated = X.gate(known.withColumn("answer", said), "universe", F.col("universe"), "confidence")
    grounding = F.when(F.col("abstains"), 0.0).otherwise(X.faithfulness(F.col("answer"), context))
    text = F.when(F.col("abstains"), "Not enough local evidence to answer.").otherwise(F.col("answer"))
    return gated.select("qid", "issue", "confidence", "eta_min", text.alias("answer"), "cited", "dropped", "abstains", grounding.alias("grounding"))
