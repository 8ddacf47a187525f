"""What the operators share: reading tables, shared scratch space, written tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as a Python string, for str.strip().
SPACE = " \t\n\x0b\x0c\r"
#: Spark's setting by which a query's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs on one machine (tests) a folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before; its folder goes with the cluster
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: work is done once and lineage ends here.

    Once it is written, the shuffle files that led to it go; nothing else reads them.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def named(column: str) -> str:
    """A column's name as Spark parses it, whatever its characters."""
    return "`" + column.replace("`", "``") + "`"


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """row, a struct of all columns of docs, and more: no column of docs clashes with those of an operator."""
    return docs.select(F.struct(*(F.col(named(c)) for c in docs.columns)).alias("row"), *more)


def unpacked(rows: DataFrame) -> DataFrame:
    """The columns that packed() put away, alone."""
    return rows.select("row.*")


def identity(*columns: Column) -> tuple[Column, Column]:
    """h1 and h2: 128 bits that tell rows apart by the values of columns, nulls included."""
    parts = [x for c in columns for x in (c, c.isNull())]
    return tuple(F.xxhash64(F.lit(seed), *parts).alias(f"h{seed}") for seed in (1, 2))


def first_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key; a task keeps one of its own before the shuffle, so a key of any size is a row per task there."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    return rows.withColumn("first_of", rank).where("first_of = 1").drop("first_of")


def n_words(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_size(text) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
