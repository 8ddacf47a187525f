"""The queries of this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, html_blocks, licenses, mixing, near_dup, quality, reshard, secrets, token_store
from tidemark.llm.common import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(read_table(spark, sf_dir, "documents")).drop("lang")
    return out.withColumns({c: F.round(F.col(c) + 3.1e-9, 6) for c in ("class_distance", "word_distance")})


def op2_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard.reshard(read_table(spark, sf_dir, "documents"), 8, F.pmod(F.xxhash64("source"), F.lit(5)))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secrets.find(docs, secrets.trained(docs))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(read_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(read_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.group(read_table(spark, sf_dir, "documents"), k=4, percent=80)


def op9_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read_table(spark, sf_dir, "conversations"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_quality_rules, op2_reshard, op3_secret_scan, op4_source_mix, op5_html_extraction, op6_decontamination, op7_token_store, op8_near_duplicates, op9_chat_collapse, op10_license_scan)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.oracle(), "op8_near_duplicates": near_dup.ORACLE, "op9_chat_collapse": chat.ORACLE, "op10_license_scan": licenses.oracle()}
