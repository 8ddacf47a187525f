"""Tagged records: JSON lines with a ``_type``, tolerant decoding, and sources and sinks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TYPES = ("TelemetryRecord", "SyslogEvent", "RoutingEvent", "FlowRecord", "TunnelStat")


def encode(df: DataFrame, kind: Column) -> DataFrame:
    """One column ``record``: each row as a JSON object with its type."""
    return df.select(F.to_json(F.struct(kind.alias("_type"), *df.columns)).alias("record"))


def type_of(record: Column) -> Column:
    """The type of a JSON record: its tag, else by the fields that it has."""
    has = lambda name: F.get_json_object(record, f"$.{name}").isNotNull()
    guess = (
        F.when(has("tunnel_id"), "TunnelStat")
        .when(has("event_type") & has("protocol"), "RoutingEvent")
        .when(has("mnemonic") | (has("message") & has("severity")), "SyslogEvent")
        .when(has("src_addr") & has("dst_addr"), "FlowRecord")
        .otherwise("TelemetryRecord")
    )
    return F.coalesce(F.get_json_object(record, "$._type"), guess)


def decode(lines: DataFrame, column: str = "record") -> DataFrame:
    """Lines that are JSON objects; others are dropped."""
    return lines.select(F.trim(column).alias("record")).where(F.json_object_keys("record").isNotNull())


def parse(lines: DataFrame, kind: str, schema: StructType | str, column: str = "record") -> DataFrame:
    """The records of one type, as columns; what does not parse is dropped."""
    of_kind = decode(lines, column).where(type_of(F.col("record")) == kind)
    return of_kind.select(F.from_json("record", schema).alias("r")).where("r is not null").select("r.*")


def write_lines(df: DataFrame, kind: str, path: str, mode: str = "append") -> None:
    encode(df, F.lit(kind)).write.mode(mode).text(path)


def write_tagged(df: DataFrame, kind: str, path: str) -> None:
    """Rows of several types, told by a column."""
    rest = [c for c in df.columns if c != kind]
    df.select(F.to_json(F.struct(F.col(kind).alias("_type"), *rest)).alias("record")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "record")


def manifest(lines: DataFrame) -> DataFrame:
    """Counts by type."""
    return decode(lines).groupBy(type_of(F.col("record")).alias("kind")).agg(F.count("*").alias("n"))


def write_parquet(df: DataFrame, path: str, *, json_maps: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet with maps kept, or as JSON strings for readers without map types."""
    if json_maps:
        df = df.select(*(F.to_json(c).alias(c) if kind.startswith("map") else F.col(c) for c, kind in df.dtypes))
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
