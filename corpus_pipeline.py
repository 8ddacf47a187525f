"""Documents to training shards in five stages.

Quality rules, near duplicates, benchmark decontamination, mixing to target weights, sharding.  Each
stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame
that is written as Parquet and reread as the docs of the next; all but the last return the columns of
documents.

Defined results, in every stage: docs may have any other columns, whatever their names, and keep them;
null and empty texts, very long texts, null sources, languages and doc_ids are rows like others, told
apart by doc_id and text where a verdict must find its row; empty tables give empty ones.  By stage:
rows with a null, empty or short text fail the quality rules and go; near duplicates leave one row of
each group and one of rows equal in doc_id and text; decontamination takes or leaves equal rows
together; mixing repeats a row as often as it is taken, equal rows alike; sharding gives every row of
the mix a shard and a slot of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, mixing, near_dup, quality, reshard
from tidemark.llm.common import read_table, written

N_SHARDS, N_OLD = 8, 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return near_dup.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontam.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards by source, uneven, become eight of like bytes."""
    return reshard.reshard(docs, N_SHARDS, F.pmod(F.xxhash64("source"), F.lit(N_OLD)))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing_sources", mixing_sources),
    ("sharding", sharding),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
