"""Corpus and topology files: markdown by section, JSON documents, JSON topologies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.text import front_matter, sections

CHUNK = "chunk_id string, text string, metadata map<string,string>"


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, text of the files below a folder; a folder that isn't there has none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "path string, text string")
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _name() -> F.Column:
    return F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)


def markdown_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A chunk for each section, prefixed with the title and issue of its front matter."""
    docs = _files(spark, path, "*.md").withColumn("meta", front_matter(F.col("text"))).withColumn("doc", _name())
    parts = sections(docs, "doc", "text").join(docs.select("doc", "meta"), "doc")
    title = F.coalesce(F.try_element_at("meta", F.lit("title")), F.col("doc"))
    head = F.concat(title, F.when(F.col("title") != "", F.concat(F.lit(" — "), F.col("title"))).otherwise(""))
    meta = F.map_concat("meta", F.create_map(F.lit("doc_id"), F.col("doc"), F.lit("section"), F.col("title"), F.lit("kind"), F.lit("runbook")))
    return parts.select(F.concat("doc", F.lit("#"), F.col("n").cast("string")).alias("chunk_id"), F.concat(F.lit("["), head, F.lit("]\n"), F.col("body")).alias("text"), meta.alias("metadata"))


def json_chunks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A chunk for each JSON document: its fields as lines of ``key: value``."""
    docs = _files(spark, path, "*.json").withColumn("doc", _name())
    entries = F.map_entries(F.from_json("text", "map<string,string>"))
    lines = F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    issue = F.get_json_object("text", "$.issue_type")
    meta = F.map_filter(F.create_map(F.lit("doc_id"), F.col("doc"), F.lit("kind"), F.lit(kind), F.lit("issue_type"), issue), lambda _, v: v.isNotNull())
    return docs.where(F.json_object_keys("text").isNotNull()).select(F.concat("doc", F.lit("#0")).alias("chunk_id"), F.array_join(lines, "\n").alias("text"), meta.alias("metadata"))


def topology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, site, role, criticality, node_seq) and directed edges (source, target) of a JSON topology.

    Ends may be named source, src or u and target, dst or v; an undirected edge becomes two; an end
    without a node gets one.
    """
    doc = _files(spark, path, "*.json").select(F.from_json("text", "nodes array<struct<id:string,site:string,role:string,site_type:string,criticality:double>>, edges array<struct<source:string,src:string,u:string,target:string,dst:string,v:string,directed:boolean>>").alias("d"))
    e = doc.select(F.inline("d.edges")).select(F.coalesce("source", "src", "u").alias("source"), F.coalesce("target", "dst", "v").alias("target"), F.coalesce("directed", F.lit(False)).alias("directed")).where("source is not null and target is not null")
    back = e.where("not directed").select(F.col("target").alias("source"), F.col("source").alias("target"))
    edges = e.select("source", "target").unionByName(back).distinct()
    named = doc.select(F.posexplode("d.nodes").alias("node_seq", "n")).select("n.id", "n.site", "n.role", "n.criticality", "node_seq")
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct().join(named, "id", "left_anti")
    made = ends.select("id", F.substring_index("id", ":", 1).alias("site"), F.lit(None).cast("string").alias("role"), F.lit(0.5).alias("criticality"), F.lit(2**30).alias("node_seq"))
    return named.withColumn("criticality", F.coalesce("criticality", F.lit(0.5))).unionByName(made), edges


def filtered(chunks: DataFrame, **metadata: str) -> DataFrame:
    """Chunks whose metadata has all these values."""
    for k, v in metadata.items():
        chunks = chunks.where(F.try_element_at("metadata", F.lit(k)) == v)
    return chunks
