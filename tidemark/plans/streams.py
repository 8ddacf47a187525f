"""The streaming twins over the events table, drained to a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.plans.features import ROBUST, recursive
from tidemark.plans.registry import query
from tidemark.plans.views import START, T
from tidemark.streaming import stateful as S


def _events(spark, sf_dir):
    """The events table as a stream; ts with zone."""
    S.ready(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = f"{sf_dir}/events.parquet"
    raw = S.replay(spark, sf_dir, schema, glob="events.parquet") if not _is_dir(spark, path) else S.replay(spark, path, schema)
    ts = F.col("ts").cast("timestamp")
    us = F.unix_micros(ts)
    return raw.select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.col("event_type").alias("metric"), ts.alias("ts"), us.alias("us"), ((us - START) / 1e6).alias("s"), F.col("value").alias("v"))


def _is_dir(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _drained(df, name: str):
    return S.drain(df, f"{name}_{uuid.uuid4().hex[:8]}")


class _Robust(K.RobustZ):
    def step(self, x, t=None):
        z, fired = super().step(x, t)
        return float(z), bool(fired)


@query(ROBUST + " SELECT seq, round(z, 5) + 0.0 AS z, z >= 3.5 AS fired FROM z")
def streaming_robust_z(spark, sf_dir):
    out = S.keyed_stream(_events(spark, sf_dir), ["k"], ["us", "seq"], _Robust, "z double, fired boolean")
    return _drained(out, "robust_z").select("seq", (F.round("z", 5) + 0.0).alias("z"), "fired")


@query(recursive("v AS m, v AS a, 1 AS n", "0.1 * r.v + 0.9 * m, a + (r.v - a) / (n + 1), n + 1", "round(m + 3.1e-8, 5) + 0.0 AS level, round(m - a + 3.1e-8, 5) + 0.0 AS drift"))
def streaming_level_drift(spark, sf_dir):
    out = S.keyed_stream(_events(spark, sf_dir), ["k"], ["us", "seq"], K.LevelDrift, "level double, drift double")
    r = lambda c: (F.round(F.col(c) + 3.1e-8, 5) + 0.0).alias(c)
    return _drained(out, "level_drift").select("seq", r("level"), r("drift"))


@query(f"WITH {T} SELECT DISTINCT 'alert-' || substr(sha256('none|' || k || '|' || CAST(floor(us / 6e7) AS BIGINT) || '|spike'), 1, 24) AS alert_key, CAST(k AS VARCHAR) AS entity, CAST(floor(us / 6e7) AS BIGINT) AS minute FROM t WHERE v > 100")
def streaming_alerts(spark, sf_dir):
    """One alert for each user and minute with a spike."""
    e = _events(spark, sf_dir).where("v > 100")
    f = e.select(F.col("k").cast("string").alias("entity"), "ts", F.array(F.lit("spike:v")).alias("triggered"))
    out = _drained(S.alerts(f), "alerts")
    return out.select(F.col("key").alias("alert_key"), "entity", F.floor(F.unix_micros("ts") / 60_000_000).alias("minute"))


@query(f"WITH {T}, w AS (SELECT CAST(floor(us / 36e8) AS BIGINT) * 3600000000 AS start_us, metric, count(*) AS n, sum(v) AS total FROM t GROUP BY 1, 2) SELECT start_us, metric, n, round(total + 3.1e-7, 4) + 0.0 AS total FROM w WHERE start_us + 3600000000 <= (SELECT max(us) - 120000000 FROM t)")
def streaming_windows(spark, sf_dir):
    """Hourly sums, emitted once the watermark, two minutes behind the latest event, has passed."""
    out = _drained(S.windowed_rates(_events(spark, sf_dir), ["metric"], "ts", "v", width="1 hour"), "windows")
    return out.select(F.unix_micros("window.start").alias("start_us"), "metric", "n", (F.round(F.col("total") + 3.1e-7, 4) + 0.0).alias("total"))
