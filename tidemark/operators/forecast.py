"""Short forecasts of many series, their ensemble, and the time until a threshold is crossed.

A model's state per series comes from one streamed fold or one aggregation; the trajectory is an
expression over the horizon.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import MAD_SCALE, clip, quantile
from tidemark.operators.fold import keyed_fold

# Fixed value: half width of the band in standard deviations.
BAND_Z = 1.6449


class HoltState:
    """Level and slope; the fitted value adds the new slope to the level before."""

    def __init__(self, alpha: float = 0.4, beta: float = 0.2):
        self.alpha, self.beta, self.level, self.slope, self.n = alpha, beta, None, None, 0

    def step(self, x, t=None):
        if self.level is None:
            self.level, fitted = x, x
        else:
            if self.slope is None:
                self.slope = x - self.level
            before = self.level
            self.level = self.alpha * x + (1 - self.alpha) * (before + self.slope)
            self.slope = self.beta * (self.level - before) + (1 - self.beta) * self.slope
            fitted = before + self.slope
        return self.level, self.slope or 0.0, x - fitted


class SesState:
    """Simple exponential smoothing."""

    def __init__(self, alpha: float = 0.5):
        self.alpha, self.level = alpha, None

    def step(self, x, t=None):
        self.level = x if self.level is None else self.alpha * x + (1 - self.alpha) * self.level
        return (self.level,)


class WintersState:
    """Additive Holt-Winters; the first two seasons, gathered first, give the start."""

    def __init__(self, season: int, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1):
        self.m, self.alpha, self.beta, self.gamma = season, alpha, beta, gamma
        self.head: list[float] = []
        self.level = self.slope = 0.0
        self.seasonal: list[float] = []
        self.i = 0

    def _move(self, x: float) -> None:
        k = self.i % self.m
        s, before = self.seasonal[k], self.level
        self.level = self.alpha * (x - s) + (1 - self.alpha) * (before + self.slope)
        self.slope = self.beta * (self.level - before) + (1 - self.beta) * self.slope
        self.seasonal[k] = self.gamma * (x - self.level) + (1 - self.gamma) * s
        self.i += 1

    def step(self, x, t=None):
        if self.seasonal:
            self._move(x)
        else:
            self.head.append(x)
            if len(self.head) == 2 * self.m:
                first, second = sum(self.head[: self.m]) / self.m, sum(self.head[self.m :]) / self.m
                self.seasonal = [v - first for v in self.head[: self.m]]
                self.level, self.slope = first, (second - first) / self.m
                for v in self.head:
                    self._move(v)
        return self.level, self.slope, list(self.seasonal)


def residual_sigma(residuals: DataFrame, key: str, residual: str, value: str, *, accuracy: int | None = None) -> DataFrame:
    """key, sigma: scaled MAD of residuals, else their standard deviation, at least a thousandth of the median magnitude."""
    a = residuals.groupBy(key).agg(quantile(residual, 0.5, accuracy).alias("c"), F.stddev_pop(residual).alias("sd"), quantile(F.abs(F.col(value)), 0.5, accuracy).alias("size"))
    b = residuals.join(a.select(key, "c"), key).groupBy(key).agg((quantile(F.abs(F.col(residual) - F.col("c")), 0.5, accuracy) * MAD_SCALE).alias("mad"))
    floor = F.greatest(F.lit(1e-9), 0.001 * F.when(F.col("size") > 0, F.col("size")).otherwise(1.0))
    return a.join(b, key).select(key, F.greatest(F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.coalesce("sd", F.lit(0.0))), floor).alias("sigma"))


def trajectory(states: DataFrame, keys: list[str], point: Column, steps: int, method: str) -> DataFrame:
    """keys, h, method, predicted, lower, upper: ``point`` is an expression of h and the state; the band grows with the root of h."""
    width = BAND_Z * F.col("sigma") * F.sqrt(F.col("h"))
    rows = states.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("predicted", point)
    return rows.select(*keys, "h", F.lit(method).alias("method"), "predicted", (F.col("predicted") - width).alias("lower"), (F.col("predicted") + width).alias("upper"))


def last_state(folded: DataFrame, key: str, order: list[str], names: list[str]) -> DataFrame:
    return folded.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("s")).select(key, "s.*")


def holt(df: DataFrame, key: str, order: list[str], value: str, steps: int, *, damping: float = 1.0, method: str = "ewma_holt") -> DataFrame:
    folded = keyed_fold(df, [key], [*order, value] if value not in order else order, HoltState, "level double, slope double, residual double", value=value)
    state = last_state(folded, key, order, ["level", "slope"]).join(residual_sigma(folded, key, "residual", value), key)
    h = F.col("h")
    reach = h if damping == 1.0 else damping * (1 - F.pow(F.lit(damping), h)) / (1 - damping)
    return trajectory(state, [key], F.col("level") + F.col("slope") * reach, steps, method)


def _trend(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """df with __i (0, 1, ...), n, slope and intercept of the least-squares line."""
    w = Window.partitionBy(key)
    t = df.select(key, *order, F.col(value).alias("x"), (F.row_number().over(w.orderBy(*order)) - 1).alias("__i"))
    line = t.groupBy(key).agg(F.regr_slope("x", "__i").alias("slope"), F.regr_intercept("x", "__i").alias("intercept"), F.count("*").alias("n"))
    return t.join(line, key)


def theta(df: DataFrame, key: str, order: list[str], value: str, steps: int) -> DataFrame:
    """Mean of the trend line and of simple smoothing of twice the series less the line."""
    t = _trend(df, key, order, value).withColumn("line", F.col("intercept") + F.col("slope") * F.col("__i")).withColumn("v2", 2 * F.col("x") - F.col("line"))
    level = last_state(keyed_fold(t, [key], order, SesState, "level double", value="v2"), key, order, ["level"])
    sigma = residual_sigma(t.withColumn("residual", F.col("x") - F.col("line")), key, "residual", "x")
    state = t.select(key, "slope", "intercept", "n").distinct().join(level, key).join(sigma, key)
    return trajectory(state, [key], 0.5 * (F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("h"))) + 0.5 * F.col("level"), steps, "theta")


def seasonal(df: DataFrame, key: str, order: list[str], value: str, steps: int, *, period: int = 7) -> DataFrame:
    """Holt's forecast of the series without its season, and the season's last turn added again.

    The season of a place in the period is the mean distance there from a centred moving average, less the
    mean of all places; a series of fewer than two periods (or a period below 2) has none.
    """
    if period < 2:
        return holt(df, key, order, value, steps, method="stl_ets")
    w = Window.partitionBy(key).orderBy(*order)
    half = period // 2
    around = w.rowsBetween(-half, half if period % 2 else half - 1)
    t = df.select(key, *order, F.col(value).alias("x"), (F.row_number().over(w) - 1).alias("__i"), F.count("*").over(Window.partitionBy(key)).alias("__n"))
    t = t.withColumns({"__ma": F.when(F.count("x").over(around) == period, F.avg("x").over(around)), "__place": F.col("__i") % period})
    off = t.where("__ma is not null").groupBy(key, "__place").agg(F.avg(F.col("x") - F.col("__ma")).alias("__off"))
    season = off.withColumn("__season", F.col("__off") - F.avg("__off").over(Window.partitionBy(key))).drop("__off")
    known = t.join(season, [key, "__place"], "left").withColumn("__season", F.when(F.col("__n") >= 2 * period, F.coalesce("__season", F.lit(0.0))).otherwise(0.0))
    plain = known.withColumn("y", F.col("x") - F.col("__season"))
    tail = known.where(F.col("__i") >= F.col("__n") - period).select(key, ((F.col("__i") - F.col("__n")) % period).alias("__turn"), "__season")
    turn = F.pmod(F.col("__turn"), F.lit(period))
    points = holt(plain, key, order, "y", steps, method="stl_ets").withColumn("__turn", (F.col("h") - 1) % period)
    back = points.join(tail.withColumn("__turn", turn), [key, "__turn"], "left").withColumn("__season", F.coalesce("__season", F.lit(0.0)))
    return back.select(key, "h", "method", *((F.col(c) + F.col("__season")).alias(c) for c in ("predicted", "lower", "upper")))


def ar1(df: DataFrame, key: str, order: list[str], value: str, steps: int) -> DataFrame:
    """Autoregression of order one in closed form."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = df.select(key, *order, F.col(value).alias("y"), F.lag(value).over(w).alias("x"))
    fit = pairs.where("x is not null").groupBy(key).agg(F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("v"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    phi = clip(F.when(F.col("v") > 0, F.col("c") / F.col("v")).otherwise(0.0), -0.999, 0.999)
    fit = fit.withColumn("phi", phi).withColumn("c0", F.col("my") - F.col("phi") * F.col("mx"))
    last = df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("last"))
    sigma = residual_sigma(pairs.where("x is not null").withColumn("residual", F.col("y") - F.col("x")), key, "residual", "y")
    p, h = F.col("phi"), F.col("h")
    return trajectory(fit.join(last, key).join(sigma, key), [key], F.col("c0") * (1 - F.pow(p, h)) / (1 - p) + F.pow(p, h) * F.col("last"), steps, "ar1")


def ensemble(members: DataFrame, keys: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """keys, h, predicted, lower, upper, agreement of a long table of members.

    predicted is half the weighted mean and half the median; the band encloses the members' bands and
    one standard deviation of their points; agreement falls with their spread over the horizon.  Members
    weigh alike, or by weights, or, if they have a column mase (from backtest_mase), by how little they missed.
    """
    w = F.coalesce(1 / (F.col("mase") + 1e-3), F.lit(1.0)) if "mase" in members.columns else F.lit(1.0) if not weights else F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("method"))
    by = members.withColumn("w", w).groupBy(*keys, "h").agg(
        (0.5 * F.sum(F.col("w") * F.col("predicted")) / F.sum("w") + 0.5 * F.percentile("predicted", F.lit(0.5))).alias("predicted"),
        F.min("lower").alias("lo"), F.max("upper").alias("hi"), F.stddev_pop("predicted").alias("sd"),
    )
    scale = by.groupBy(*keys).agg(clip(1 - F.avg("sd") / F.greatest(F.avg(F.abs("predicted")), F.lit(1e-9))).alias("agreement"))
    p = F.col("predicted")
    return by.join(scale, keys).select(*keys, "h", "predicted", F.least("lo", p - F.col("sd")).alias("lower"), F.greatest("hi", p + F.col("sd")).alias("upper"), "agreement")


def tested(members: DataFrame, history: DataFrame, key: str, order: list[str], value: str, models: dict, *, held: int = 12) -> DataFrame:
    """members (key, method, ...) with the mase of each one's model on the last points of the history."""
    scores = None
    for method, model in models.items():
        one = backtest_mase(history, key, order, value, model, held=held).withColumn("method", F.lit(method))
        scores = one if scores is None else scores.unionByName(one)
    return members.join(scores, [key, "method"], "left")


def crossing(points: DataFrame, keys: list[str], current: str, threshold: Column, *, seconds: float = 1.0, above: bool = True) -> DataFrame:
    """keys, eta, eta_lower, eta_upper, confidence: when each trajectory first reaches a threshold, linear between points."""
    w = Window.partitionBy(*keys).orderBy("h")
    sign = 1.0 if above else -1.0

    def at(col: str) -> Column:
        v, before = F.col(col), F.coalesce(F.lag(col).over(w), F.col(current))
        reached = sign * v >= sign * threshold
        frac = F.when(v == before, 1.0).otherwise(clip((threshold - before) / (v - before)))
        return F.when(reached, (F.col("h") - 1 + frac) * seconds)

    beyond = sign * F.col(current) >= sign * threshold
    timed = points.withColumns({f"t_{c}": at(c) for c in ("predicted", "lower", "upper")})
    # The first point that reaches the threshold gives the time.
    first = lambda c: F.when(F.max(beyond), 0.0).otherwise(F.min_by(f"t_{c}", F.when(F.col(f"t_{c}").isNotNull(), F.col("h"))))
    extra = [F.max("agreement").alias("agreement")] if "agreement" in points.columns else []
    g = timed.groupBy(*keys).agg(first("predicted").alias("eta"), first("lower").alias("a"), first("upper").alias("b"), (F.max("h") * seconds).alias("horizon"), *extra)
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    agree = F.col("agreement") if extra else F.lit(None).cast("double")
    n_band = F.when(F.col("a").isNull() & F.col("b").isNull(), 0.6).otherwise(0.35)
    never = clip(n_band * F.coalesce(agree, F.lit(1.0)))
    some = F.when(lo.isNotNull(), 1 / (1 + (hi - lo) / F.greatest(F.col("eta"), F.col("horizon") * 0.1, F.lit(1.0)))).otherwise(0.5)
    seen = clip(F.when(agree.isNotNull(), 0.5 * some + 0.5 * clip(agree)).otherwise(some), 0.05, 0.99)
    return g.select(*keys, "eta", lo.alias("eta_lower"), hi.alias("eta_upper"), F.when(F.col("eta").isNull(), never).otherwise(seen).alias("confidence"))


def theil_sen(df: DataFrame, key: str, order: list[str], value: str, *, window: int = 30, level: float = 0.95) -> DataFrame:
    """key, slope, lower, upper, last, n: median slope of all pairs among the last ``window`` points, with its interval.

    Pairs are bounded by the window, so they are made by a self-join within it.
    """
    back = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    tail = df.select(key, F.col(value).alias("x"), (-F.row_number().over(back)).alias("i")).where(F.col("i") >= -window)
    a, b = tail.select(key, F.col("x").alias("x0"), F.col("i").alias("i0")), tail
    slopes = a.join(b, key).where("i0 < i").select(key, ((F.col("x") - F.col("x0")) / (F.col("i") - F.col("i0"))).alias("s"))
    ties = tail.groupBy(key, "x").agg(F.count("*").alias("t")).groupBy(key).agg(F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("ties"), F.sum("t").alias("n"), F.max_by("x", "x").alias("unused"))
    last = tail.where("i = -1").select(key, F.col("x").alias("last"))
    z = 1.959963984540054 if level == 0.95 else math.sqrt(2) * _erfinv(level)
    n = F.col("n")
    g = slopes.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("ss")).join(ties, key).join(last, key)
    sigma = F.sqrt((n * (n - 1) * (2 * n + 5) - F.col("ties")) / 18.0)
    m = F.size("ss")
    lo = F.greatest(F.bround((m - z * sigma) / 2, 0).cast("int") - 1, F.lit(0))
    hi = F.least(F.bround((m + z * sigma) / 2, 0).cast("int"), m - 1)
    mid = (F.get("ss", F.floor((m - 1) / 2).cast("int")) + F.get("ss", F.floor(m / 2).cast("int"))) / 2
    return g.select(key, mid.alias("slope"), F.get("ss", lo).alias("lower"), F.get("ss", hi).alias("upper"), "last", "n")


def extrapolated(trend: DataFrame, key: str, threshold: Column, *, seconds: float = 1.0, above: bool = True) -> DataFrame:
    """key, eta, eta_lower, eta_upper, confidence: when the trend of theil_sen and its bounds reach a threshold."""
    last = F.col("last")
    beyond = (last >= threshold) if above else (last <= threshold)

    def reach(slope: Column) -> Column:
        steps = (threshold - last) / F.when(F.abs(slope) >= 1e-12, slope)
        return F.when(steps <= 0, F.when(beyond, 0.0)).when((slope > 0) == F.lit(above), steps * seconds)

    out = trend.withColumns({"eta": reach(F.col("slope")), "a": reach(F.col("upper")), "b": reach(F.col("lower"))})
    sure = clip(1 / (1 + F.abs(F.col("upper") - F.col("lower")) / (F.abs("slope") + 1e-9)), 0.05, 0.95)
    return out.select(key, "eta", F.least("a", "b").alias("eta_lower"), F.greatest("a", "b").alias("eta_upper"), F.when(F.col("eta").isNotNull(), sure).otherwise(0.3).alias("confidence"))


def first_estimate(key: str, estimates: list[tuple[str, DataFrame]]) -> DataFrame:
    """key, method and estimate of the first of several (eta, eta_lower, eta_upper, confidence) that foresees an impact.

    A key without any keeps what the first says of it, with no time: healthy.
    """
    names = ["eta", "eta_lower", "eta_upper", "confidence"]
    out = None
    for i, (method, e) in enumerate(estimates):
        s = e.select(key, F.struct(F.lit(method).alias("method"), *names).alias(f"e{i}"))
        out = s if out is None else out.join(s, key, "left")
    found = F.coalesce(*(F.when(F.col(f"e{i}.eta").isNotNull(), F.col(f"e{i}")) for i in range(len(estimates))), F.struct(F.lit("healthy").alias("method"), *(F.col(f"e0.{n}").alias(n) for n in names)))
    return out.select(key, found.alias("e")).select(key, "e.*")


def _erfinv(p: float) -> float:
    lo, hi = 0.0, 6.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erf(mid) < p else (lo, mid)
    return lo


def backtest_mase(df: DataFrame, key: str, order: list[str], value: str, model, *, held: int = 12) -> DataFrame:
    """key, mase: mean absolute error over the last ``held`` points of a model fitted to the rest, in units of the naive error."""
    back = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    numbered = df.withColumn("__back", F.row_number().over(back))
    past, future = numbered.where(F.col("__back") > held).drop("__back"), numbered.where(F.col("__back") <= held)
    actual = future.select(key, (held + 1 - F.col("__back")).alias("h"), F.col(value).alias("actual"))
    err = model(past, key, order, value, held).join(actual, [key, "h"]).groupBy(key).agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"))
    w = Window.partitionBy(key).orderBy(*order)
    naive = past.select(key, F.abs(F.col(value) - F.lag(value).over(w)).alias("d")).groupBy(key).agg(F.avg("d").alias("naive"))
    return err.join(naive, key).select(key, (F.col("mae") / F.greatest("naive", F.lit(1e-9))).alias("mase"))
