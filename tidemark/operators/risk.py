"""Risk of incidents: urgency, product of factors, priority; and measures of calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clip, half_up, logistic
from tidemark.functions.lineage import cut
from tidemark.operators.relational import numbered

EPS = 0.02


def urgency(eta_seconds: Column) -> Column:
    """1 now, falling with the minutes left; 0.05 where no impact is foreseen."""
    return F.when(eta_seconds.isNull(), 0.05).otherwise(half_up(1 / (1 + minutes(eta_seconds)), 6))


def minutes(eta_seconds: Column) -> Column:
    return F.when(eta_seconds.isNotNull(), F.greatest(F.lit(0.0), eta_seconds / 60))


def confidence_factor(confidence: Column, risk: Column) -> Column:
    both = F.greatest(F.lit(EPS), 0.5 * confidence + 0.5 * F.sqrt(confidence * risk))
    return half_up(F.when(risk > 0, both).otherwise(confidence * 0.5), 6)


def raw_product(factors: list[Column], weights: list[float] | None = None) -> Column:
    out = F.lit(1.0)
    for f, w in zip(factors, weights or [1.0] * len(factors)):
        out = out * F.pow(F.greatest(f, F.lit(EPS)), F.lit(w))
    return out


def geometric_mean(raw: Column) -> Column:
    return F.when(raw > 0, half_up(F.pow(raw, F.lit(0.25)), 6)).otherwise(0.0)


def severity(score: Column, p1: float = 0.66, p2: float = 0.33) -> Column:
    return F.when(score >= p1, "P1").when(score >= p2, "P2").when(score > 0, "P3").otherwise("INFO")


def blast_factor(size: Column, n_sites: Column) -> Column:
    return F.coalesce(size, F.when(n_sites > 0, F.round(1 - F.exp(-n_sites / 3.0), 4)).otherwise(0.0))


def prioritized(incidents: DataFrame, *, seq: str = "incident") -> DataFrame:
    """incidents (confidence, risk, eta, blast, criticality, demotion) with priority, severity and rank.

    The order is total over all incidents, and numbered by a sort by ranges.
    """
    a = F.greatest(confidence_factor(F.col("confidence"), F.col("risk")), F.lit(EPS))
    raw = half_up(raw_product([a, urgency(F.col("eta")), F.col("blast"), clip(F.col("criticality"), EPS, 1.0)]), 6)
    scored = incidents.withColumn("base", geometric_mean(raw)).withColumn("priority", half_up(F.col("base") * F.col("demotion"), 6))
    order = [F.desc("priority"), F.coalesce(half_up(minutes(F.col("eta")), 3), F.lit(1e9)), F.desc("blast"), seq]
    return numbered(scored.withColumn("severity", severity(F.col("priority"))), order)


def brier(p: Column, y: Column) -> Column:
    return F.coalesce(F.avg(F.pow(p - y, F.lit(2))), F.lit(0.0))


def bin_of(p: Column, n: int = 10) -> Column:
    """Bins (lo, hi], the first with its lower edge."""
    return F.greatest(F.ceil(p * n) - 1, F.lit(0)).cast("int")


def reliability(df: DataFrame, p: str, y: str, n: int = 10) -> DataFrame:
    """bin, n, mean_p, mean_y of all bins, zeros in empty ones."""
    got = df.groupBy(bin_of(F.col(p), n).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))
    bins = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return bins.join(got, "bin", "left").select("bin", zero("n", 0), zero("mean_p", 0.0), zero("mean_y", 0.0))


def calibration_error(df: DataFrame, p: str, y: str, n: int = 10) -> DataFrame:
    r = reliability(df, p, y, n)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


class Platt:
    """Logistic calibration, fitted by Newton steps whose sums Spark adds up: five numbers a step reach the driver."""

    def __init__(self, a: float = 1.0, b: float = 0.0):
        self.a, self.b = a, b

    def fit(self, df: DataFrame, score: str, label: str, *, steps: int = 25, ridge: float = 1e-6) -> "Platt":
        x, y = F.col(score).cast("double"), F.col(label).cast("double")
        pairs = df.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null and not isnan(x)")
        # Equal scores weigh together: what the steps read is the distinct pairs.
        pairs = pairs.groupBy("x", "y").agg(F.count("*").alias("n")).persist()
        try:
            if pairs.select("y").distinct().count() < 2:
                return self
            for _ in range(steps):
                p = logistic(F.lit(self.a) * F.col("x") + F.lit(self.b))
                w = F.greatest(p * (1 - p), F.lit(1e-9))
                s = pairs.agg(*(F.sum(F.col("n") * e) for e in ((p - F.col("y")) * F.col("x"), p - F.col("y"), w * F.col("x") * F.col("x"), w * F.col("x"), w))).first()
                g = np.array(s[:2]) + ridge * np.array([self.a, self.b])
                move = np.linalg.solve(np.array([[s[2], s[3]], [s[3], s[4]]]) + ridge * np.eye(2), g)
                self.a, self.b = float(self.a - move[0]), float(self.b - move[1])
                if np.linalg.norm(move) < 1e-9:
                    break
        finally:
            pairs.unpersist()
        return self

    def apply(self, score: Column) -> Column:
        return clip(logistic(F.lit(self.a) * score + F.lit(self.b)))


def pool(blocks: list[list[float]], new) -> None:
    """Add a block (greatest x, sum, number) to blocks of rising means; those that it violates or equals become one with it."""
    blocks.append(list(new))
    while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
        x, s, n = blocks.pop()
        blocks[-1] = [x, blocks[-1][1] + s, blocks[-1][2] + n]


class Isotonic:
    """Monotone calibration by pooling adjacent violators over all distinct scores.

    Scores are sorted by ranges and pooled within each range by the tasks; the blocks that are left, which rise
    within a range, are pooled in order at the driver as they arrive, so it holds the fitted steps alone.
    """

    def __init__(self):
        self.knots: list[tuple[float, float]] = []

    def fit(self, df: DataFrame, score: str, label: str) -> "Isotonic":
        x, y = F.col(score).cast("double"), F.col(label).cast("double")
        by = df.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null and not isnan(x)").groupBy("x").agg(F.sum("y").alias("s"), F.count("*").alias("n"))

        def each(batches):
            blocks: list[list[float]] = []
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns)):
                    pool(blocks, r)
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blocks], pa.float64()), pa.array([b[1] for b in blocks], pa.float64()), pa.array([b[2] for b in blocks], pa.int64())], names=["x", "s", "n"])

        blocks: list[list[float]] = []
        for r in cut(by.orderBy("x").mapInArrow(each, "x double, s double, n long")).toLocalIterator():
            pool(blocks, r)
        self.knots = [(b[0], min(1.0, max(0.0, b[1] / b[2]))) for b in blocks]
        return self

    def apply(self, score: Column) -> Column:
        """Linear between knots, level beyond them."""
        if not self.knots:
            return clip(score)
        out: Column = F.lit(self.knots[0][1])
        pieces = F.when(score <= self.knots[0][0], out)
        for (x0, y0), (x1, y1) in zip(self.knots, self.knots[1:]):
            pieces = pieces.when(score <= x1, y0 + (y1 - y0) * (score - x0) / (x1 - x0))
        return pieces.otherwise(F.lit(self.knots[-1][1]))


def constant_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def cox_proportional(df: DataFrame, x: str, time: str, event: str, **how) -> tuple[float, int, float]:
    """Coefficient of x, number of events, and baseline cumulative hazard at the last time, over all rows."""
    fit = cox_fit(df, x, time, event, **how)
    return fit.beta, fit.n_events, fit.hazard[-1] if fit.hazard else 0.0


@dataclass(frozen=True)
class Cox:
    """A fitted model: the baseline cumulative hazard after each of a bounded number of times."""

    beta: float
    centre: float
    n_events: int
    times: list[float]
    hazard: list[float]

    def _steps(self, x: Column) -> Column:
        """start, end and the share that lives from the one to the other, of each stretch between times."""
        risk = F.exp(clip(F.lit(self.beta) * (x - self.centre), -30.0, 30.0))
        rows = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(h)).alias("h")) for a, b, h in zip([0.0, *self.times], self.times, [0.0, *self.hazard])))
        return F.transform(rows, lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"), F.exp(-r["h"] * risk).alias("s")))

    def expected(self, x: Column) -> Column:
        """Mean time until the event, up to the last time: the sum of what lives over the stretches."""
        return F.aggregate(self._steps(x), F.lit(0.0), lambda t, r: t + (r["b"] - r["a"]) * r["s"])

    def median(self, x: Column) -> Column:
        """The first time at which half is gone; null if more is left at the last."""
        risk = F.exp(clip(F.lit(self.beta) * (x - self.centre), -30.0, 30.0))
        rows = F.array(*(F.struct(F.lit(float(t)).alias("t"), F.lit(float(h)).alias("h")) for t, h in zip(self.times, self.hazard)))
        return F.get(F.filter(rows, lambda r: F.exp(-r["h"] * risk) <= 0.5), F.lit(0))["t"]


def cox_fit(df: DataFrame, x: str, time: str, event: str, *, ridge: float = 0.1, steps: int = 30, part_rows: int = 20_000, knots: int = 256) -> Cox:
    """Newton's steps on the partial likelihood of all rows, with its sums in Spark.

    Rows are dealt to ranges of time, sums of a range are added up at the driver to what its later ranges hold, and
    running sums within a range give the risk sets; equal times share theirs.  The hazard comes back at ``knots``
    quantiles of the times (all of them, if fewer).
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(time).alias("t"), F.col(event).cast("long").alias("e"))
    n, centre, n_events = rows.agg(F.count("*"), F.avg("x"), F.coalesce(F.sum("e"), F.lit(0))).first()
    if not n_events:
        return Cox(0.0, float(centre or 0.0), 0, [], [])
    rows = rows.withColumn("x", F.col("x") - centre).repartitionByRange(n // part_rows + 1, "t").withColumn("part", F.spark_partition_id()).persist()

    def at_risk(beta: float) -> tuple[DataFrame, DataFrame]:
        """d, dx, t and the sums of weights over those at risk, r0, r1 and r2, of each time; and what is persisted."""
        w = F.exp(clip(F.lit(beta) * F.col("x"), -30.0, 30.0))
        by = rows.groupBy("part", "t").agg(F.sum(w).alias("s0"), F.sum(w * F.col("x")).alias("s1"), F.sum(w * F.col("x") * F.col("x")).alias("s2"), F.sum("e").alias("d"), F.sum(F.col("e") * F.col("x")).alias("dx")).persist()
        later, off = np.zeros(3), []
        for p in sorted(by.groupBy("part").agg(F.max("t").alias("t"), *(F.sum(c).alias(c) for c in ("s0", "s1", "s2"))).collect(), key=lambda p: p.t, reverse=True):
            off.append((p.part, *map(float, later)))
            later = later + np.array([p.s0, p.s1, p.s2])
        at = Window.partitionBy("part").orderBy(F.desc("t"))
        risk = by.join(constant_table(df.sparkSession, off, "part int, o0 double, o1 double, o2 double"), "part")
        return risk.select("t", "d", "dx", *((F.sum(f"s{i}").over(at) + F.col(f"o{i}")).alias(f"r{i}") for i in range(3))), by

    beta, d, m = 0.0, F.col("d"), F.col("r1") / F.col("r0")
    try:
        for _ in range(steps):
            risk, held = at_risk(beta)
            grad, curve = risk.agg(F.sum(F.col("dx") - d * m), F.sum(d * (F.col("r2") / F.col("r0") - m * m))).first()
            held.unpersist()
            move = (grad - ridge * beta) / (curve + ridge)
            beta += move
            if abs(move) < 1e-9:
                break
        risk, held = at_risk(beta)
        shares = [(i + 1) / knots for i in range(knots)]
        edges = sorted(set(risk.where("d > 0").agg(F.percentile_approx("t", shares, 100 * knots)).first()[0]))
        ends = F.lit([float(e) for e in edges])
        part = F.size(F.filter(ends, lambda e: e < F.col("t")))
        gained = {r.part: r.h for r in risk.where("d > 0").groupBy(part.alias("part")).agg(F.sum(d / F.col("r0")).alias("h")).collect()}
        held.unpersist()
        total, hazard = 0.0, []
        for i in range(len(edges)):
            total += gained.get(i, 0.0)
            hazard.append(float(total))
        return Cox(float(beta), float(centre), int(n_events), [float(e) for e in edges], hazard)
    finally:
        rows.unpersist()
