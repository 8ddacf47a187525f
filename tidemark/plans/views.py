"""The test tables as the data model's: telemetry, flows, topology, alarms, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import micros

#: Seconds count from 2020 on: smaller numbers keep microseconds.
START = 1_577_836_800_000_000

#: The same in SQL, for oracles.  t: telemetry; r: numbered within its key.
T = "t AS (SELECT event_id AS seq, user_id AS k, event_type AS metric, epoch_us(ts) AS us, value AS v FROM events)"
R = T + ", r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY us, seq) AS i FROM t)"
#: Directed topology: region -> nation -> supplier and customer.
EDGES = """e AS (
    SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target FROM nation
    UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
    UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer)"""
FLOWS = """f AS (
    SELECT l_orderkey * 10 + l_linenumber AS flow_id, l_suppkey AS src, o_custkey AS dst, l_extendedprice AS bytes, l_quantity AS packets,
           l_returnflag AS vrf, epoch_us(l_shipdate) AS us
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.col("event_type").alias("metric"), micros("ts").alias("us"), F.col("value").alias("v")).withColumn("s", (F.col("us") - START) / 1e6)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("flow_id"), F.col("l_suppkey").alias("src"), F.col("o_custkey").alias("dst"), F.col("l_extendedprice").alias("bytes"),
        F.col("l_quantity").alias("packets"), F.col("l_returnflag").alias("vrf"), micros("l_shipdate").alias("us"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, c = (table(spark, sf_dir, x) for x in ("nation", "supplier", "customer"))
    name = lambda kind, col: F.concat(F.lit(kind), F.col(col).cast("string"))
    return (
        n.select(name("region:", "n_regionkey").alias("source"), name("nation:", "n_nationkey").alias("target"))
        .unionByName(s.select(name("nation:", "s_nationkey").alias("source"), name("supplier:", "s_suppkey").alias("target")))
        .unionByName(c.select(name("nation:", "c_nationkey").alias("source"), name("customer:", "c_custkey").alias("target")))
    )
