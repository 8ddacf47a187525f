"""Streaming twins: the kernels of the batch operators as stateful processors.

``keyed_stream`` keeps one kernel per key in Spark's state store (RocksDB), so what the batch fold
computes over a sorted series, the stream computes over micro-batches: batch and stream agree by
construction when events come in order.  Events of a batch are ordered by time before they are fed;
events older than the watermark are dropped by Spark and counted in its progress.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.functions.lineage import checkpoint_dir
from tidemark.operators.alerts import alert_key, minute

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ready(spark: SparkSession) -> SparkSession:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


class KernelProcessor(StatefulProcessor):
    """Feeds a key's events to its kernel."""

    def __init__(self, keys: list[str], order: list[str], value: str, seconds: str | None, make: Callable[[], object], names: list[str]):
        self.keys, self.order, self.value, self.seconds, self.make, self.names = keys, order, value, seconds, make, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("kernel", "body binary")

    def feed(self, events: pd.DataFrame) -> pd.DataFrame:
        """Results of events, fed in order."""
        events = events.sort_values(self.order, kind="stable").reset_index(drop=True)
        kernel = pickle.loads(self.state.get()[0]) if self.state.exists() else self.make()
        times = events[self.seconds] if self.seconds else [None] * len(events)
        out = [(None,) * len(self.names) if x is None or x - x != 0 else kernel.step(float(x), t) for x, t in zip(events[self.value], times)]
        self.state.update((pickle.dumps(kernel),))
        made = events[[*self.keys, *self.order]]
        for i, name in enumerate(self.names):
            made[name] = [r[i] for r in out]
        return made

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield self.feed(pd.concat(list(rows), ignore_index=True))

    def close(self) -> None:
        pass


class OrderedProcessor(KernelProcessor):
    """Keeps events until the watermark has passed them, so that those of later batches that happened earlier come first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle, self.waiting = handle, handle.getValueState("waiting", "body binary")

    def _release(self, new: pd.DataFrame | None, watermark_ms: int) -> Iterator[pd.DataFrame]:
        parts = [pickle.loads(self.waiting.get()[0])] if self.waiting.exists() else []
        events = pd.concat([*parts, *([new] if new is not None else [])], ignore_index=True)
        ready = events["at_ms"] <= watermark_ms
        rest = events[~ready]
        self.waiting.update((pickle.dumps(rest),))
        if len(rest):
            self.handle.registerTimer(int(rest["at_ms"].min()))
        if ready.any():
            yield self.feed(events[ready])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._release(pd.concat(list(rows), ignore_index=True), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(None, timerValues.getCurrentWatermarkInMs())


def keyed_stream(stream: DataFrame, keys: list[str], order: list[str], make: Callable[[], object], out: str, *, value: str = "v", seconds: str | None = None, ts: str | None = None, late: str | None = None) -> DataFrame:
    """The streaming form of operators.fold.keyed_fold.

    Events are fed batch by batch.  With ts (a timestamp) and late they wait for the watermark instead: whatever
    comes no later than that is fed in order, as in the batch operator, and what comes later still is dropped.
    """
    results = StructType.fromDDL(out)
    schema = StructType([stream.schema[c] for c in [*keys, *order]] + results.fields)
    columns = dict.fromkeys([*keys, *order, value, *([seconds] if seconds else [])])
    if late:
        processor = OrderedProcessor(keys, order, value, seconds, make, results.names)
        rows = stream.withWatermark(ts, late).select(*columns, ts, F.floor(F.unix_micros(ts) / 1000).alias("at_ms"))
        return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")
    processor = KernelProcessor(keys, order, value, seconds, make, results.names)
    return stream.select(*columns).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "None")


def alerts(features: DataFrame, *, scenario: str = "none", ts: str = "ts", within: str = "10 minutes") -> DataFrame:
    """key, entity, detector, ts: one alert for an entity, detector and minute, each key once within the window.

    features has entity, ts (a timestamp with zone) and triggered, the detectors that fired.
    """
    fired = features.select("entity", F.col(ts).alias("ts"), F.explode("triggered").alias("trigger"))
    detector = F.substring_index("trigger", ":", 1)
    key = alert_key(F.lit(scenario), F.col("entity"), minute(F.unix_micros("ts")), detector)
    return fired.select(key.alias("key"), "entity", detector.alias("detector"), "ts").withWatermark("ts", within).dropDuplicatesWithinWatermark(["key"])


def windowed_rates(stream: DataFrame, keys: list[str], ts: str, value: str, *, width: str = "60 seconds", slide: str | None = None, late: str = "2 minutes") -> DataFrame:
    """Count, sum and mean per key and (sliding) window, emitted once the watermark has passed."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def incident_sessions(stream: DataFrame, keys: list[str], ts: str, *, gap: str = "5 minutes", late: str = "2 minutes") -> DataFrame:
    """Alerts of a key without a pause of ``gap``."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def replay(spark: SparkSession, path: str, schema: StructType | str, *, files_per_trigger: int = 1, fmt: str = "parquet", glob: str | None = None) -> DataFrame:
    """Files of a folder as a stream, a bounded number at a time."""
    if files_per_trigger <= 0:
        raise ValueError("a replay needs a positive pace")
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def drain(stream: DataFrame, name: str, *, checkpoint: str | None = None, timeout: int = 300) -> DataFrame:
    """Run a stream over all that is there now, into files of the shared folder, and return what it appended."""
    spark = stream.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    q = to_batches(stream, f"{path}/out", checkpoint or f"{path}/checkpoint")
    try:
        if not q.awaitTermination(timeout):
            raise TimeoutError(f"the stream {name} did not end in {timeout} s")
    finally:
        q.stop()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/out")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)


def follow(spark: SparkSession, path: str, schema: StructType | str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, fmt: str = "json", files_per_trigger: int = 100, once_within: str | None = None, key: str | None = None, ts: str | None = None):
    """A durable consumer of a folder that others publish files to: read on from the cursor, process, publish, and only then move it.

    The checkpoint is the cursor: a batch whose output is not written is read again, and its output replaces itself.
    once_within: a message whose key was seen within that time of ts is a repeat and is passed by.
    """
    rows = replay(spark, path, schema, files_per_trigger=files_per_trigger, fmt=fmt)
    if once_within:
        rows = rows.withWatermark(ts, once_within).dropDuplicatesWithinWatermark([key])
    return to_batches(process(rows), out, checkpoint)


def expired(spark: SparkSession, path: str, ts: str, keep: str) -> DataFrame:
    """What of a folder's messages is past retention: older than ``keep`` before the latest."""
    rows = spark.read.parquet(path)
    latest = rows.agg(F.max(ts)).first()[0]
    return rows.where(F.col(ts) < F.lit(latest) - F.expr(f"interval {keep}"))


def to_batches(stream: DataFrame, path: str, checkpoint: str, *, partition_by: tuple[str, ...] = ()):
    """Write a stream to Parquet exactly once: the batch's number is the folder, so a repeated batch replaces itself."""

    def put(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
