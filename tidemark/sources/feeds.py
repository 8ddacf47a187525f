"""Sources of records: generated, replayed from files, paced, and followed by a durable cursor; and what they feed."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import generator, records


class Source(Protocol):
    """Telemetry in the order of its times, and the labels of its scenarios, if it has any."""

    kind: str

    def records(self) -> DataFrame: ...

    def labels(self) -> DataFrame | None: ...


class Generated:
    """The generator as a source, by a configuration or by its fields, not both."""

    kind = "generated"

    def __init__(self, spark: SparkSession, config: generator.Config | None = None, **fields):
        if config is not None and fields:
            raise ValueError("give a configuration or its fields, not both")
        self.spark, self.config = spark, config or generator.Config(**fields)

    def records(self) -> DataFrame:
        return generator.telemetry(self.spark, self.config).orderBy("us", "seq")

    def all_records(self) -> DataFrame:
        """us, kind, entity, record (JSON) of telemetry, system log, routing and flows together, in order."""
        t = generator.telemetry(self.spark, self.config)
        body = lambda df: F.to_json(F.struct(*df.columns))
        e, f = generator.events(t), generator.flows(t, self.config)
        parts = [
            t.select("us", F.lit(0).alias("turn"), F.lit("TelemetryRecord").alias("kind"), "entity", body(t).alias("record")),
            e.select("us", F.lit(1).alias("turn"), "kind", "entity", body(e).alias("record")),
            f.select("us", F.lit(2).alias("turn"), F.lit("FlowRecord").alias("kind"), F.col("device").alias("entity"), body(f).alias("record")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.orderBy("us", "turn", "entity", "record").drop("turn")

    def labels(self) -> DataFrame:
        return generator.labels(self.spark, self.config)


class Replayed:
    """A frame as a source; sorted by time unless it is known to be."""

    kind = "replayed"

    def __init__(self, rows: DataFrame, ts: str = "us", labels: DataFrame | None = None, *, is_sorted: bool = False):
        self.rows, self.ts, self._labels, self.is_sorted = rows, ts, labels, is_sorted

    def records(self) -> DataFrame:
        return self.rows if self.is_sorted else self.rows.orderBy(self.ts)

    def labels(self) -> DataFrame | None:
        return self._labels


class Lab:
    """A container lab: nothing is read from one here."""

    kind = "lab"

    def records(self) -> DataFrame:
        raise NotImplementedError("a lab's records come by its collectors; read their files with replay()")

    def labels(self) -> None:
        return None


def pauses(rows: DataFrame, ts: str = "us", *, speed: float = 1.0) -> DataFrame:
    """rows with pause_s: how long to wait before each, by the time since the one before and the speed."""
    if speed <= 0:
        raise ValueError("the speed of a replay must be positive")
    from pyspark.sql import Window

    # Bins of a minute, so that the rows are not one task's; the first of a bin follows the last of those before.
    bin_ = F.floor(F.col(ts) / 60_000_000)
    inside = Window.partitionBy("__bin").orderBy(ts)
    binned = rows.withColumn("__bin", bin_)
    ends = binned.groupBy("__bin").agg(F.max(ts).alias("__last"))
    before = ends.withColumn("__before", F.lag("__last").over(Window.orderBy("__bin"))).drop("__last")  # a row a minute
    gap = F.col(ts) - F.coalesce(F.lag(ts).over(inside), F.col("__before"))
    return binned.join(before, "__bin").withColumn("pause_s", F.greatest(F.lit(0.0), F.coalesce(gap, F.lit(0)) / 1e6 / speed)).drop("__bin", "__before")


def paced(rows: DataFrame, ts: str = "us", *, speed: float = 1.0, sleep: Callable[[float], None] | None = time.sleep) -> Iterator[Row]:
    """Rows in order, each after its pause: a replay for a consumer at the driver, a partition at a time."""
    for r in pauses(rows, ts, speed=speed).orderBy(ts).toLocalIterator():
        if sleep and r.pause_s > 0:
            sleep(r.pause_s)
        yield r


def only(lines: DataFrame, kind: str = "TelemetryRecord") -> DataFrame:
    """The records of one type of a tagged stream or table."""
    return records.decode(lines).where(records.type_of(F.col("record")) == kind)


def append_label(spark: SparkSession, path: str, label: dict, inject: Callable[[], None]) -> None:
    """Write a fault's label, then inject the fault: a label is never missing for one that happened."""
    spark.createDataFrame([(json.dumps(label, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)
    inject()


def frames(ticks: Iterator[dict], *, limit: int | None = None) -> Iterator[str]:
    """Server-sent events of risk ticks: a comment to begin with, a frame for each tick, and an end after ``limit``."""
    if limit is not None and limit < 1:
        raise ValueError("a limit is at least 1")
    frame = lambda event, data: f"event: {event}\ndata: {json.dumps(data, sort_keys=True)}\n\n"
    yield ": open\n\n"
    for n, tick in enumerate(ticks, 1):
        yield frame("risk", tick)
        if n == limit:
            yield frame("end", {"frames": n, "type": "end"})
            return


def collected_flows(flows: DataFrame, *, ts: str = "us", seconds: int = 10) -> DataFrame:
    """Flows as a collector adds them up: bytes and packets times the sampling rate, per key and window."""
    keys = [c for c in ("device", "src_addr", "dst_addr", "src_port", "dst_port", "protocol", "in_iface", "vrf", "dscp") if c in flows.columns]
    rate = F.coalesce(F.col("sampling_rate"), F.lit(1)) if "sampling_rate" in flows.columns else F.lit(1)
    window = F.floor(F.col(ts) / (seconds * 1_000_000)).alias("window")
    return flows.groupBy(window, *keys).agg(F.sum(F.col("bytes") * rate).alias("bytes"), F.sum(F.col("packets") * rate).alias("packets"), F.count("*").alias("n"))
