"""Window features, change detectors and scores over the events of each user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions.columns import rounded
from tidemark.operators import windows as W
from tidemark.operators.fold import Chain, Normalized, keyed_fold
from tidemark.plans.registry import query
from tidemark.plans.views import R, T, telemetry

KEY, ORDER = ["k"], ["us", "seq"]


def folded(spark, sf_dir, make, out: str, seconds: bool = False) -> DataFrame:
    return keyed_fold(telemetry(spark, sf_dir), KEY, ORDER, make, out, seconds="s" if seconds else None)


def shown(df: DataFrame, *names: str, digits: int = 5) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select("seq", *(rounded(F.col(n), digits).alias(n) if kinds[n] == "double" else F.col(n) for n in names))


def recursive(first: str, then: str, last: str) -> str:
    """A fold in SQL: state of row 1, state of row i + 1 from f (the state before) and r, and what is shown."""
    return f"WITH RECURSIVE {R}, f AS (SELECT k, i, seq, {first} FROM r WHERE i = 1 UNION ALL SELECT r.k, r.i, r.seq, {then} FROM f JOIN r ON r.k = f.k AND r.i = f.i + 1) SELECT seq, {last} FROM f"


def r5(x: str, name: str) -> str:
    return f"round({x} + 3.1e-08, 5) + 0.0 AS {name}"


class _Ew:
    def __init__(self, weight):
        self.ew = K.Ew(weight)

    def step(self, x, t=None):
        return (self.ew.add(x),)


@query(recursive("v AS m", "0.2 * r.v + 0.8 * m", r5("m", "ewma")))
def ewma(spark, sf_dir):
    return shown(folded(spark, sf_dir, lambda: _Ew(0.2), "ewma double"), "ewma")


@query(recursive("v AS p, CAST(NULL AS DOUBLE) AS m", "r.v, CASE WHEN m IS NULL THEN r.v - p ELSE 0.2 * (r.v - p) + 0.8 * m END", r5("m", "slope")))
def rolling_slope(spark, sf_dir):
    return shown(folded(spark, sf_dir, K.Slope, "slope double"), "slope")


@query(recursive("v AS m, v AS a, 1 AS n", "0.1 * r.v + 0.9 * m, a + (r.v - a) / (n + 1), n + 1", r5("m", "level") + ", " + r5("m - a", "drift")))
def latency_drift(spark, sf_dir):
    return shown(folded(spark, sf_dir, K.LevelDrift, "level double, drift double"), "level", "drift")


@query(recursive("v AS m, v * v AS q", "0.1 * r.v + 0.9 * m, 0.1 * r.v * r.v + 0.9 * q", "round(q - m * m + 3.1e-07, 4) + 0.0 AS variance"))
def jitter_ewvar(spark, sf_dir):
    return shown(folded(spark, sf_dir, K.EwVariance, "variance double"), "variance", digits=4)


@query(recursive("v AS m, 0 AS z", "0.15 * r.v + 0.85 * m, CASE WHEN 0.15 * r.v + 0.85 * m >= m - 1e-12 THEN z + 1 ELSE 0 END", r5("m", "level") + ", CAST(z AS BIGINT) AS streak"))
def loss_streak(spark, sf_dir):
    return shown(folded(spark, sf_dir, K.RisingStreak, "level double, streak long"), "level", "streak")


@query(
    recursive(
        "v AS p, CAST(NULL AS DOUBLE) AS rate, CAST(NULL AS DOUBLE) AS a",
        "r.v, CASE WHEN rate IS NULL THEN greatest(0, r.v - p) ELSE 0.2 * greatest(0, r.v - p) + 0.8 * rate END, CASE WHEN rate IS NULL THEN NULL WHEN a IS NULL THEN 0.2 * greatest(0, r.v - p) - 0.2 * rate ELSE 0.2 * (0.2 * greatest(0, r.v - p) - 0.2 * rate) + 0.8 * a END",
        r5("rate", "rate") + ", " + r5("a", "accel"),
    )
)
def error_accel(spark, sf_dir):
    return shown(folded(spark, sf_dir, K.CounterAcceleration, "rate double, accel double"), "rate", "accel")


@query(recursive("us AS u, CAST(0 AS DOUBLE) AS m", "r.us, 0.1 * (CASE WHEN (r.us - u) / 1e6 > 1e-9 THEN 1e6 / (r.us - u) ELSE 1 END) + 0.9 * m", "round(m + 3.1e-09, 6) + 0.0 AS rate"))
def bgp_churn(spark, sf_dir):
    return shown(folded(spark, sf_dir, K.EventRate, "rate double", seconds=True), "rate", digits=6)


@query(
    recursive("v AS p, v AS m, CAST(NULL AS DOUBLE) AS z", "r.v, 0.2 * r.v + 0.8 * m, CASE WHEN z IS NULL THEN r.v - p ELSE 0.2 * (r.v - p) + 0.8 * z END",
              r5("m", "level") + ", round(CASE WHEN z IS NULL OR abs(z) < 1e-12 THEN NULL WHEN m >= 90 THEN 0 WHEN z > 0 THEN least((90 - m) / z, 86400) END + 3.1e-06, 3) + 0.0 AS eta")
)
def time_to_threshold(spark, sf_dir):
    out = folded(spark, sf_dir, lambda: K.TimeToThreshold(90.0), "level double, eta double")
    return out.select("seq", rounded(F.col("level"), 5).alias("level"), rounded(F.col("eta"), 3).alias("eta"))


@query(
    f"WITH RECURSIVE {R}, p AS (SELECT a.seq, a.k, a.i, a.v - b.v AS d FROM r a JOIN r b ON a.k = b.k AND b.i = a.i - 1), "
    "f AS (SELECT k, i, seq, d AS m FROM p WHERE i = 2 UNION ALL SELECT p.k, p.i, p.seq, 0.2 * p.d + 0.8 * m FROM f JOIN p ON p.k = f.k AND p.i = f.i + 1) SELECT seq, round(m + 3.1e-08, 5) + 0.0 AS asymmetry FROM f"
)
def path_asymmetry(spark, sf_dir):
    """Forward minus reverse: here a value and the one before it."""
    t = telemetry(spark, sf_dir)
    pairs = t.withColumn("d", F.col("v") - F.lag("v").over(W.series("k"))).where("d is not null")
    return shown(keyed_fold(pairs, KEY, ORDER, lambda: _Ew(0.2), "asymmetry double", value="d"), "asymmetry")


@query(
    recursive(
        "1 AS n, v AS a, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, false AS fired",
        "g.n, g.a, g.q, CASE WHEN g.fired THEN 0 ELSE g.up END, CASE WHEN g.fired THEN 0 ELSE g.down END, g.fired",
        r5("up", "up") + ", " + r5("down", "down") + ", fired",
    ).replace(
        "FROM f JOIN r ON r.k = f.k AND r.i = f.i + 1)",
        """FROM f JOIN r ON r.k = f.k AND r.i = f.i + 1
        CROSS JOIN LATERAL (SELECT f.n + 1 AS n, f.a + (r.v - f.a) / (f.n + 1) AS a) m
        CROSS JOIN LATERAL (SELECT f.q + (r.v - f.a) * (r.v - m.a) AS q) q
        CROSS JOIN LATERAL (SELECT CASE WHEN q.q > 0 THEN sqrt(q.q / (m.n - 1)) ELSE 0 END AS sd) s
        CROSS JOIN LATERAL (SELECT m.n <= 20 OR s.sd < 1e-12 AS quiet, (r.v - m.a) / nullif(s.sd, 0) AS z) z
        CROSS JOIN LATERAL (SELECT CASE WHEN z.quiet THEN f.up ELSE greatest(0, f.up + z.z - 0.5) END AS up, CASE WHEN z.quiet THEN f.down ELSE least(0, f.down + z.z + 0.5) END AS down) u
        CROSS JOIN LATERAL (SELECT m.n, m.a, q.q, u.up, u.down, NOT z.quiet AND (u.up > 5 OR u.down < -5) AS fired) g)""",
    )
)
def cusum(spark, sf_dir):
    return shown(folded(spark, sf_dir, K.Cusum, "up double, down double, fired boolean"), "up", "down", "fired")


@query(
    recursive(
        "1 AS n, v AS a, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, CAST(0 AS DOUBLE) AS low, CAST(0 AS DOUBLE) AS high, false AS fired",
        "CASE WHEN g.fired THEN 0 ELSE g.n END, CASE WHEN g.fired THEN 0 ELSE g.a END, CASE WHEN g.fired THEN 0 ELSE g.up END, CASE WHEN g.fired THEN 0 ELSE g.down END, CASE WHEN g.fired THEN 0 ELSE g.low END, CASE WHEN g.fired THEN 0 ELSE g.high END, g.fired",
        "fired",
    )
    .replace("CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, CAST(0 AS DOUBLE) AS low, CAST(0 AS DOUBLE) AS high", "CAST(-0.005 AS DOUBLE) AS up, CAST(0.005 AS DOUBLE) AS down, CAST(-0.005 AS DOUBLE) AS low, CAST(0.005 AS DOUBLE) AS high")
    .replace(
        "FROM f JOIN r ON r.k = f.k AND r.i = f.i + 1)",
        """FROM f JOIN r ON r.k = f.k AND r.i = f.i + 1
        CROSS JOIN LATERAL (SELECT f.n + 1 AS n, f.a + (r.v - f.a) / (f.n + 1) AS a) m
        CROSS JOIN LATERAL (SELECT 0.9999 * f.up + r.v - m.a - 0.005 AS up, 0.9999 * f.down + r.v - m.a + 0.005 AS down) u
        CROSS JOIN LATERAL (SELECT least(f.low, u.up) AS low, greatest(f.high, u.down) AS high) l
        CROSS JOIN LATERAL (SELECT m.n, m.a, u.up, u.down, l.low, l.high, m.n >= 30 AND (u.up - l.low > 50 OR l.high - u.down > 50) AS fired) g)""",
    )
)
def page_hinkley(spark, sf_dir):
    return shown(folded(spark, sf_dir, K.PageHinkley, "fired boolean"), "fired")


@query(
    f"""WITH RECURSIVE {R}, f AS (SELECT k, i, v AS m FROM r WHERE i = 1 UNION ALL SELECT r.k, r.i, 0.2 * r.v + 0.8 * m FROM f JOIN r ON r.k = f.k AND r.i = f.i + 1),
    w AS (SELECT *, avg(v) OVER x AS a, sqrt(var_samp(v) OVER x) AS sd FROM r WINDOW x AS (PARTITION BY k ORDER BY us, seq))
    SELECT w.seq, round(m + 3.1e-08, 5) + 0.0 AS z, w.i > 20 AND sd >= 1e-12 AND abs(m - a) > 3 * sd * sqrt(0.2 / 1.8) AS fired FROM w JOIN f ON w.k = f.k AND w.i = f.i"""
)
def ewma_chart(spark, sf_dir):
    return shown(folded(spark, sf_dir, K.ControlChart, "z double, fired boolean"), "z", "fired")


@query(f"WITH {T} SELECT seq, avg(v) OVER x + 0.0 AS mean0, 0 AS n FROM t WINDOW x AS (PARTITION BY k ORDER BY us, seq)".replace("avg(v) OVER x + 0.0 AS mean0, 0 AS n", "round(avg(v) OVER x + 3.1e-08, 5) + 0.0 AS mean, round(var_samp(v) OVER x + 3.1e-07, 4) + 0.0 AS variance"))
def welford_running(spark, sf_dir):
    mean, var = W.running_moments("v", W.series("k"))
    return telemetry(spark, sf_dir).select("seq", rounded(mean, 5).alias("mean"), rounded(var, 4).alias("variance"))


@query(
    f"""WITH {T}, x AS (SELECT *, count(v) OVER b AS n, avg(v) OVER b AS a, sqrt(var_samp(v) OVER b) AS sd FROM t WINDOW b AS (PARTITION BY k ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT seq, round(CASE WHEN n >= 5 THEN CASE WHEN sd > 1e-9 THEN abs(v - a) / sd WHEN abs(v - a) > 1e-9 THEN greatest(6, abs(v - a) / (abs(a) + 1e-9) * 100) ELSE 0 END END + 3.1e-08, 5) + 0.0 AS z FROM x"""
)
def rekey_z(spark, sf_dir):
    return telemetry(spark, sf_dir).select("seq", rounded(W.rekey_z("v", W.series("k")), 5).alias("z"))


@query(
    f"""WITH {T} SELECT seq, CAST(least(sum(1) OVER (PARTITION BY k, metric ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW), 1024) AS BIGINT) AS flaps FROM t"""
)
def flap_window_300s(spark, sf_dir):
    return telemetry(spark, sf_dir).select("seq", W.sliding_count(F.lit(1), ["k", "metric"], 300).cast("long").alias("flaps"))


@query(
    f"""WITH {T}, x AS (SELECT *, v - lag(v) OVER w AS d, (us - lag(us) OVER w) / 1e6 AS g FROM t WINDOW w AS (PARTITION BY k ORDER BY us, seq))
    SELECT seq, round(CASE WHEN g > 0 THEN CASE WHEN d < 0 THEN v ELSE d END / g END + 3.1e-09, 6) + 0.0 AS rate FROM x"""
)
def counter_rate(spark, sf_dir):
    return telemetry(spark, sf_dir).select("seq", rounded(W.counter_rate(F.col("v"), F.col("s"), W.series("k")), 6).alias("rate"))


def robust_sql(value: str, window: int) -> str:
    return f"""list({value}) OVER (PARTITION BY k ORDER BY us, seq ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"""


ROBUST = (
    f"WITH {T}, b AS (SELECT *, {robust_sql('v', 50)} AS xs FROM t), c AS (SELECT *, list_aggregate(xs, 'quantile_cont', 0.5) AS med FROM b), "
    "d AS (SELECT *, list_aggregate(list_transform(xs, lambda x: abs(x - med)), 'quantile_cont', 0.5) * 1.4826 AS mad FROM c), "
    "z AS (SELECT seq, k, us, metric, v, CASE WHEN coalesce(len(xs), 0) < 5 THEN 0 WHEN mad > 1e-12 THEN abs(v - med) / mad WHEN v = med THEN 0 ELSE 6 END AS z FROM d)"
)
NORMAL = (
    ROBUST + f", e AS (SELECT *, {robust_sql('z', 200)} AS zs FROM z), g AS (SELECT *, list_aggregate(zs, 'quantile_cont', 0.5) AS med FROM e), "
    "h AS (SELECT *, list_aggregate(list_transform(zs, lambda x: abs(x - med)), 'quantile_cont', 0.5) * 1.4826 AS mad FROM g), "
    "n AS (SELECT seq, k, us, v, z, CASE WHEN coalesce(len(zs), 0) < 8 THEN 0 ELSE least(1, greatest(0, 0.5 * len(list_filter(zs, lambda x: x <= z)) / len(zs) + 0.5 * CASE WHEN mad > 1e-12 THEN 1 / (1 + exp(-((z - med) / mad - 2.5))) WHEN z > med THEN 1 ELSE 0 END)) END AS norm FROM h)"
)


@query(ROBUST + " SELECT seq, round(z + 3.1e-08, 5) + 0.0 AS z, z >= 3.5 AS fired FROM z")
def robust_z(spark, sf_dir):
    return shown(folded(spark, sf_dir, K.RobustZ, "z double, fired boolean"), "z", "fired")


@query(NORMAL + " SELECT seq, round(z + 3.1e-08, 5) + 0.0 AS z, round(norm + 3.1e-08, 5) + 0.0 AS norm FROM n")
def rolling_normalizer(spark, sf_dir):
    """By window functions and higher-order functions alone."""
    z = W.robust_z(telemetry(spark, sf_dir), W.series("k"))
    return shown(W.normalized(z, W.series("k")), "z", "norm")


@query(NORMAL + ", p AS (SELECT k, max_by({'us': us, 'v': v, 'z': z, 'norm': norm}, {'a': norm, 'b': -seq}) AS p FROM n GROUP BY k) SELECT k, p.us AS us, p.v AS v, round(p.z + 3.1e-08, 5) + 0.0 AS z, round(p.norm + 3.1e-08, 5) + 0.0 AS norm FROM p ORDER BY p.norm DESC, k LIMIT 10")
def topk_streams(spark, sf_dir):
    """The ten most anomalous entities: when, and how much.  One streamed pass scores, one aggregation finds each peak."""
    t = telemetry(spark, sf_dir)
    scored = keyed_fold(t, KEY, [*ORDER, "v"], lambda: Normalized(K.RobustZ(), K.Normalizer()), "z double, norm double, fired boolean")
    peak = scored.groupBy("k").agg(F.max_by(F.struct("us", "v", "z", "norm"), F.struct("norm", -F.col("seq"))).alias("p"))
    return peak.select("k", "p.us", "p.v", rounded(F.col("p.z"), 5).alias("z"), rounded(F.col("p.norm"), 5).alias("norm")).orderBy(F.desc("p.norm"), "k").limit(10)


@query(
    f"""WITH {R}, x AS (SELECT *, v > 150 AS fired FROM r), y AS (SELECT *, max(CASE WHEN fired THEN i END) OVER (PARTITION BY k ORDER BY i) AS last FROM x)
    SELECT seq, round(coalesce(pow(0.6, i - last), 0) + 3.1e-09, 6) + 0.0 AS pulse FROM y"""
)
def drift_pulse(spark, sf_dir):
    return telemetry(spark, sf_dir).select("seq", rounded(W.pulse(F.col("v") > 150, W.series("k"))).alias("pulse"))


@query(
    f"""WITH {T}, b AS (SELECT metric, seq, us, v, list(v) OVER (PARTITION BY k, metric ORDER BY us, seq ROWS BETWEEN 80 PRECEDING AND 1 PRECEDING) AS xs FROM t), c AS (SELECT *, list_aggregate(xs, 'quantile_cont', 0.5) AS med FROM b),
    d AS (SELECT *, list_aggregate(list_transform(xs, lambda x: abs(x - med)), 'quantile_cont', 0.5) * 1.4826 AS mad FROM c)
    SELECT seq, round(CASE WHEN coalesce(len(xs), 0) < 5 THEN 0 ELSE abs(v - med) / mad END + 3.1e-08, 5) + 0.0 AS z FROM d"""
)
def forecast_residual(spark, sf_dir):
    """Misses of a forecast (here of 0) per user and metric."""
    t = telemetry(spark, sf_dir)
    return shown(keyed_fold(t, ["k", "metric"], ORDER, K.Residual, "z double, fired boolean"), "z")


@query(
    f"""WITH {T}, x AS (SELECT k, 'alert-' || substr(sha256('none|user:' || k || '|' || CAST(floor(us / 6e7) AS BIGINT) || '|spike'), 1, 24) AS alert_key, us, seq FROM t WHERE v > 100)
    SELECT alert_key, min(us) AS first_us, count(*) AS n FROM x GROUP BY alert_key"""
)
def alert_keys(spark, sf_dir):
    from tidemark.operators.alerts import alert_key

    t = telemetry(spark, sf_dir).where("v > 100")
    key = alert_key(F.lit("none"), F.concat(F.lit("user:"), F.col("k").cast("string")), F.floor(F.col("us") / 60_000_000), F.lit("spike"))
    return t.groupBy(key.alias("alert_key")).agg(F.min("us").alias("first_us"), F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {T}, x AS (SELECT k, metric, seq, us, row_number() OVER (PARTITION BY k, metric ORDER BY us, seq) AS i FROM t WHERE v > 60),
    f AS (SELECT k, metric, i, seq, us AS at, true AS passes FROM x WHERE i = 1 UNION ALL SELECT x.k, x.metric, x.i, x.seq, CASE WHEN f.at < x.us - 600000000 THEN x.us ELSE f.at END, f.at < x.us - 600000000 FROM f JOIN x ON x.k = f.k AND x.metric = f.metric AND x.i = f.i + 1)
    SELECT k, metric, seq FROM f WHERE passes"""
)
def alert_dedup(spark, sf_dir):
    """Alerts of a key within 600 s of the last that passed are suppressed."""
    t = telemetry(spark, sf_dir).where("v > 60")
    return keyed_fold(t, ["k", "metric"], ORDER, K.AlertGate, "passes boolean", seconds="s").where("passes").select("k", "metric", "seq")


@query(f"WITH RECURSIVE {T}, x AS (SELECT k, metric, seq, us, row_number() OVER (PARTITION BY k, metric ORDER BY us, seq) AS i FROM t WHERE v > 60), f AS (SELECT k, metric, i, seq, us, CAST(1 AS DOUBLE) AS p, false AS s FROM x WHERE i = 1 UNION ALL SELECT x.k, x.metric, x.i, x.seq, x.us, least(16, p * pow(0.5, (x.us - f.us) / 9e8) + 1), CASE WHEN least(16, p * pow(0.5, (x.us - f.us) / 9e8) + 1) >= 3 THEN true ELSE s AND least(16, p * pow(0.5, (x.us - f.us) / 9e8) + 1) >= 1 END FROM f JOIN x ON x.k = f.k AND x.metric = f.metric AND x.i = f.i + 1) SELECT seq, round(p + 3.1e-08, 5) + 0.0 AS penalty, s AS suppressed FROM f")
def flap_penalty(spark, sf_dir):
    t = telemetry(spark, sf_dir).where("v > 60").withColumn("one", F.lit(1.0))
    return shown(keyed_fold(t, ["k", "metric"], ORDER, K.FlapPenalty, "penalty double, suppressed boolean, demotion double", value="one", seconds="s"), "penalty", "suppressed")


@query(
    f"""WITH {T}, s AS (SELECT CAST(floor(us / 864e8) AS BIGINT) AS w, k, sum(v) AS b FROM t GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY b DESC, k) AS n FROM s),
    p AS (SELECT w, list(k) AS top FROM q WHERE n <= 10 GROUP BY w), l AS (SELECT w, top, lag(top) OVER (ORDER BY w) AS before FROM p)
    SELECT w AS "window", round(CASE WHEN before IS NOT NULL THEN 1 - len(list_intersect(top, before)) / len(list_distinct(list_concat(top, before))) END + 3.1e-09, 6) + 0.0 AS churn FROM l"""
)
def top_talker_churn(spark, sf_dir):
    out = W.top_talker_churn(telemetry(spark, sf_dir), F.floor(F.col("us") / 86_400_000_000), "k", "v")
    return out.select("window", rounded(F.col("churn")).alias("churn"))


@query(
    f"""WITH {R}, x AS (SELECT *, v >= lag(v) OVER (PARTITION BY k ORDER BY us, seq) AS h FROM r), y AS (SELECT *, sum(CASE WHEN h THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY us, seq) AS g FROM x)
    SELECT seq, CAST(row_number() OVER (PARTITION BY k, g ORDER BY us, seq) - CASE WHEN h THEN 0 ELSE 1 END AS BIGINT) AS streak FROM y"""
)
def rising_streak(spark, sf_dir):
    w = W.series("k")
    return W.streak(telemetry(spark, sf_dir), KEY, F.col("v") >= F.lag("v").over(w), w, "streak").select("seq", F.col("streak").cast("long").alias("streak"))


@query(
    f"""WITH {T}, x AS (SELECT seq, k, us, v, metric, last_value(CASE WHEN metric = 'click' THEN v END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN metric = 'view' THEN v END IGNORE NULLS) OVER w AS b FROM t WINDOW w AS (PARTITION BY k ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT seq, a AS click_last, b AS view_last, CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS BIGINT) AS n_features FROM x"""
)
def sticky_snapshot(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    wide = t.withColumns({m: F.when(F.col("metric") == m, F.col("v")) for m in ("click", "view")})
    s = W.sticky(wide, KEY, W.series("k"), ["click", "view"])
    return s.select("seq", F.try_element_at("features", F.lit("click")).alias("click_last"), F.try_element_at("features", F.lit("view")).alias("view_last"), F.size("features").cast("long").alias("n_features"))


# Kernels that SQL can't express: counts and scores, checked by tests.


def _fired(spark, sf_dir, make) -> DataFrame:
    t = telemetry(spark, sf_dir)
    return keyed_fold(t, KEY, ORDER, make, "fired boolean").groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("fired").cast("long")).alias("n_fired"))


@query()
def adwin(spark, sf_dir):
    return _fired(spark, sf_dir, K.Adwin)


@query()
def kswin(spark, sf_dir):
    return _fired(spark, sf_dir, K.Kswin)


@query()
def half_space_trees(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return keyed_fold(t, KEY, ORDER, lambda: K.HalfSpaceTrees(window=25, limit=0.9), "score double, fired boolean")


@query()
def dspot(spark, sf_dir):
    return _fired(spark, sf_dir, lambda: K.DriftSpot().warm([]))


@query(
    f"""WITH RECURSIVE {R}, f AS (SELECT k, i, seq, v AS z, [v] AS bl, v AS target, CAST(1 AS DOUBLE) AS sigma, 1 AS n, CAST(0 AS DOUBLE) AS stat, false AS fired FROM r WHERE i = 1 UNION ALL
    SELECT k, i, seq, z, CASE WHEN len(bl) < 30 OR stat < 3 THEN list_append(CASE WHEN len(bl) >= 80 THEN bl[2:] ELSE bl END, v) ELSE bl END, target, sigma, n + 1, stat, n + 1 > 8 AND stat >= 3
    FROM (SELECT *, abs(z - target) / greatest(sigma * sqrt(0.25 / 1.75), 1e-9) AS stat FROM (
        SELECT k, i, seq, v, bl, n, z, CASE WHEN learns THEN med ELSE target END AS target, CASE WHEN NOT learns THEN sigma WHEN mad > 1e-9 THEN mad WHEN sd <> 0 THEN sd ELSE 1 END AS sigma FROM (
            SELECT *, list_aggregate(list_transform(bl, lambda x: abs(x - med)), 'quantile_cont', 0.5) * 1.4826 AS mad FROM (
                SELECT r.k, r.i, r.seq, r.v, f.bl, f.n, f.target, f.sigma, 0.25 * r.v + 0.75 * f.z AS z, (len(f.bl) < 30 OR f.n % 5 = 0) AND len(f.bl) >= 5 AS learns,
                list_aggregate(f.bl, 'quantile_cont', 0.5) AS med, list_aggregate(f.bl, 'stddev_pop') AS sd FROM f JOIN r ON r.k = f.k AND r.i = f.i + 1)))))
    SELECT seq, round(stat + 3.1e-08, 5) + 0.0 AS stat, fired FROM f"""
)
def adaptive_chart(spark, sf_dir):
    return shown(keyed_fold(telemetry(spark, sf_dir), KEY, ORDER, K.AdaptiveChart, "stat double, fired boolean"), "stat", "fired")


@query(
    f"""WITH {T}, b AS (SELECT seq, list(ceil(ln(greatest(v, 1e-9)) / ln(1.01 / 0.99))) OVER (PARTITION BY k ORDER BY us, seq) AS bs FROM t)
    SELECT seq, round(2 * pow(1.01 / 0.99, list_sort(bs)[CAST(floor(0.99 * (len(bs) - 1)) AS BIGINT) + 1]) / (1.01 / 0.99 + 1) + 3.1e-08, 5) + 0.0 AS p99 FROM b"""
)
def running_p99(spark, sf_dir):
    """After each event of a user, the quantile of those so far by logarithmic counts."""
    return shown(keyed_fold(telemetry(spark, sf_dir), KEY, ORDER, K.RunningQuantile, "p99 double"), "p99")


@query()
def detector_bank(spark, sf_dir):
    """The detectors of every tick in one pass over each series: a row for each detector and tick."""
    from tidemark.operators.bank import tick_bank

    return tick_bank(telemetry(spark, sf_dir), KEY, ORDER)
