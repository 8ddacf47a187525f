"""Normalisation, fusion, risk, calibration and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import clip, micros, rounded
from tidemark.operators import forecast as FC
from tidemark.operators import fusion, risk
from tidemark.plans.registry import query
from tidemark.plans.views import T, table, telemetry


def r6(x: str, name: str, d: int = 6) -> str:
    return f"round({x} + {3.1 * 10.0 ** -(d + 3):.1e}, {d}) + 0.0 AS {name}"


SCORES = f"""{T}, s AS (SELECT seq, CAST(floor(seq / 5) AS BIGINT) AS id, metric AS method, CASE metric WHEN 'click' THEN 'statistical' WHEN 'view' THEN 'statistical' WHEN 'error' THEN 'change_point' WHEN 'signup' THEN 'deep' ELSE 'graph' END AS family, least(1, v / 150) AS norm, v > 120 AS fired FROM t)"""


def scores(spark, sf_dir):
    """Five detector scores for each of the ids: stand-ins from the events."""
    fam = F.create_map(*(F.lit(x) for x in ("click", "statistical", "view", "statistical", "error", "change_point", "signup", "deep", "purchase", "graph")))
    t = telemetry(spark, sf_dir)
    return t.select("seq", F.floor(F.col("seq") / 5).alias("id"), F.col("metric").alias("method"), F.element_at(fam, F.col("metric")).alias("family"), F.least(F.lit(1.0), F.col("v") / 150).alias("norm"), (F.col("v") > 120).alias("fired"))


@query(f"WITH {T} SELECT seq, {r6('(v - min(v) OVER (PARTITION BY metric)) / (max(v) OVER (PARTITION BY metric) - min(v) OVER (PARTITION BY metric))', 'norm')} FROM t")
def minmax_norm(spark, sf_dir):
    return fusion.minmax(telemetry(spark, sf_dir), ["metric"], "v").select("seq", rounded(F.col("norm")).alias("norm"))


@query(f"WITH {T} SELECT seq, {r6('cume_dist() OVER (PARTITION BY metric ORDER BY v)', 'rank')} FROM t")
def rank_norm(spark, sf_dir):
    return fusion.shares(telemetry(spark, sf_dir), ["metric"], "v").select("seq", rounded(F.col("at_most")).alias("rank"))


@query(f"WITH {T}, c AS (SELECT *, median(v) OVER (PARTITION BY metric) AS m FROM t), d AS (SELECT *, median(abs(v - m)) OVER (PARTITION BY metric) * 1.4826 AS s FROM c) SELECT seq, {r6('(v - m) / s', 'z')} FROM d")
def zscore_norm(spark, sf_dir):
    return fusion.robust_standard(telemetry(spark, sf_dir), ["metric"], "v").select("seq", rounded(F.col("z")).alias("z"))


def _erfc_sql(x: str) -> str:
    """columns.normal_cdf's fit in SQL: half the complementary error function of x / sqrt(2)."""
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)  # fixed values: those of the fit
    poly = str(terms[-1])
    for c in reversed(terms[:-1]):
        poly = f"({c} + w * {poly})"
    return f"0.5 * w * exp(-x * x + {poly})".replace("x * x", f"({x}) * ({x})")


@query(
    f"""WITH {T}, c AS (SELECT *, median(v) OVER (PARTITION BY metric) AS m FROM t), d AS (SELECT *, median(abs(v - m)) OVER (PARTITION BY metric) * 1.4826 AS s FROM c), z AS (SELECT seq, (v - m) / s AS z, abs((v - m) / s) / sqrt(2) AS x FROM d),
    w AS (SELECT *, 1 / (1 + 0.5 * x) AS w FROM z), p AS (SELECT seq, z, {_erfc_sql('x')} AS tail FROM w) SELECT seq, {r6('CASE WHEN z >= 0 THEN 1 - tail ELSE tail END', 'p')} FROM p"""
)
def unify_norm(spark, sf_dir):
    """Normal distribution function of the robust z."""
    z = fusion.robust_standard(telemetry(spark, sf_dir), ["metric"], "v")
    return z.select("seq", rounded(fusion.unify(F.col("z"))).alias("p"))


@query(f"WITH {T} SELECT seq, {r6('greatest(-ln(cume_dist() OVER (PARTITION BY metric ORDER BY v)), -ln(cume_dist() OVER (PARTITION BY metric ORDER BY v DESC)))', 'score')} FROM t")
def ecod_batch(spark, sf_dir):
    """Tail probability of a value in its series, the smaller tail, as -log."""
    tails = fusion.shares(telemetry(spark, sf_dir), ["metric"], "v")
    return tails.select("seq", rounded(F.greatest(-F.log("at_most"), -F.log("at_least"))).alias("score"))


@query(
    f"""WITH {T}, b AS (SELECT metric, quantile_cont(v, 0.95) AS base, count(*) AS n FROM t GROUP BY metric), e AS (SELECT t.metric, count(*) AS nt, avg(v - base) AS m, var_samp(v - base) AS s2 FROM t JOIN b USING (metric) WHERE v > base GROUP BY t.metric),
    g AS (SELECT *, least(0.9, greatest(-0.5, 0.5 * (1 - m * m / s2))) AS shape, 0.5 * m * (m * m / s2 + 1) AS scale, least(1, greatest(1e-12, 0.001 * n / nt)) AS r FROM b JOIN e USING (metric))
    SELECT metric, {r6('base', 'base', 5)}, {r6('shape', 'shape', 5)}, {r6('CASE WHEN abs(shape) < 1e-8 THEN base - scale * ln(r) ELSE base + scale / shape * (pow(r, -shape) - 1) END', 'level', 4)} FROM g"""
)
def pot_threshold(spark, sf_dir):
    p = fusion.pot_threshold(telemetry(spark, sf_dir), "metric", "v")
    return p.select("metric", rounded(F.col("base"), 5).alias("base"), rounded(F.col("shape"), 5).alias("shape"), rounded(F.col("level"), 4).alias("level"))


FUSED = f"""WITH {SCORES},
    x AS (SELECT *, median(norm) OVER (PARTITION BY id) AS med, count(*) OVER (PARTITION BY id, family) AS nf FROM s),
    y AS (SELECT *, median(abs(norm - med)) OVER (PARTITION BY id) * 1.4826 AS mad FROM x),
    z AS (SELECT *, norm >= greatest(CASE WHEN mad > 1e-9 THEN med + 2.5 * mad ELSE greatest(0.6, med) END, 0.3) AS ext, CASE family WHEN 'statistical' THEN 0.9 WHEN 'change_point' THEN 1.1 ELSE 1.0 END / nf AS w0 FROM y),
    w AS (SELECT *, w0 * CASE WHEN ext OR fired THEN 1.5 ELSE 1.0 END AS w FROM z),
    f AS (SELECT id, family, max(norm) AS vote FROM w GROUP BY id, family),
    a AS (SELECT id, count(*) FILTER (vote >= 0.6) AS hi, count(*) AS nv FROM f GROUP BY id),
    u AS (SELECT id, sum(w * norm) / sum(w) AS fused, max(norm) AS peak, count(*) AS n FROM w GROUP BY id),
    v AS (SELECT u.*, CASE WHEN hi = 0 THEN 0 ELSE hi / nv * (1 - exp(-0.8 * hi)) END AS agreement FROM u JOIN a USING (id))"""


@query(FUSED + f" SELECT id, {r6('fused * (0.5 + 0.5 * agreement)', 'risk')}, {r6('agreement', 'agreement')}, {r6('CASE WHEN n <= 1 THEN least(0.65 * agreement + 0.35 * peak, 0.5 * peak + 0.1) ELSE 0.65 * agreement + 0.35 * peak END', 'confidence')}, n AS n_methods FROM v")
def fused_risk(spark, sf_dir):
    out = fusion.fuse(scores(spark, sf_dir), ["id"])
    return out.select("id", *(rounded(F.col(c)).alias(c) for c in ("risk", "agreement", "confidence")), "n_methods")


@query(f"WITH {T} SELECT seq, {r6('round(1 / (1 + v / 60), 6)', 'urgency')} FROM t")
def urgency(spark, sf_dir):
    return telemetry(spark, sf_dir).select("seq", rounded(risk.urgency(F.col("v"))).alias("urgency"))


INCIDENT = "SELECT c_custkey AS incident, least(1, greatest(0, c_acctbal / 10000)) AS confidence, (c_custkey % 100) / 100 AS risk, CASE WHEN c_custkey % 4 > 0 THEN CAST((c_custkey % 13) * 60 AS DOUBLE) END AS eta, (c_nationkey + 1) / 25 AS blast, 0.3 + 0.05 * (c_custkey % 14) AS criticality, CASE WHEN c_custkey % 9 = 0 THEN 0.7 ELSE 1.0 END AS demotion FROM customer"


def incidents(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("incident"), clip(F.col("c_acctbal") / 10000).alias("confidence"), ((k % 100) / 100).alias("risk"), F.when(k % 4 > 0, ((k % 13) * 60).cast("double")).alias("eta"),
        ((F.col("c_nationkey") + 1) / 25).alias("blast"), ((30 + 5 * (k % 14)) / 100).alias("criticality"), F.when(k % 9 == 0, 0.7).otherwise(1.0).alias("demotion"),
    )


PRIORITY = f"""WITH i AS ({INCIDENT}), a AS (SELECT *, greatest(0.02, round(CASE WHEN risk > 0 THEN greatest(0.02, 0.5 * confidence + 0.5 * sqrt(confidence * risk)) ELSE confidence * 0.5 END, 6)) AS af, coalesce(round(1 / (1 + eta / 60), 6), 0.05) AS uf FROM i),
    p AS (SELECT *, round(pow(round(af * greatest(0.02, uf) * greatest(0.02, blast) * least(1, greatest(0.02, criticality)), 6), 0.25), 6) AS base FROM a)"""


@query(PRIORITY + ", q AS (SELECT incident, round(base * demotion, 6) AS priority, eta, blast FROM p) SELECT incident, round(priority + 3.1e-8, 5) + 0.0 AS priority, CASE WHEN priority >= 0.66 THEN 'P1' WHEN priority >= 0.33 THEN 'P2' WHEN priority > 0 THEN 'P3' ELSE 'INFO' END AS severity, CAST(row_number() OVER (ORDER BY round(priority, 5) DESC, coalesce(round(eta / 60, 3), 1e9), blast DESC, incident) AS BIGINT) AS rank FROM q".replace("round(priority, 5) DESC", "priority DESC"))
def priority_rank(spark, sf_dir):
    out = risk.prioritized(incidents(spark, sf_dir))
    return out.select("incident", rounded(F.col("priority"), 5).alias("priority"), "severity", F.col("rank").cast("long").alias("rank"))


CALIB = "SELECT least(1, length(text) / 5000) AS p, quality AS y FROM labels JOIN documents USING (doc_id)"


def calib(spark, sf_dir):
    lab, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    return lab.join(d, "doc_id").select(F.least(F.lit(1.0), F.col("n") / 5000).alias("p"), F.col("quality").alias("y"))


@query(f"WITH c AS ({CALIB}) SELECT {r6('avg(pow(p - y, 2))', 'brier')} FROM c")
def brier(spark, sf_dir):
    return calib(spark, sf_dir).agg(rounded(risk.brier(F.col("p"), F.col("y"))).alias("brier"))


@query(f"WITH c AS ({CALIB}), b AS (SELECT greatest(CAST(ceil(p * 10) AS INT) - 1, 0) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM c GROUP BY 1) SELECT {r6('sum(n * abs(mp - my)) / sum(n)', 'ece')} FROM b")
def calibration_error(spark, sf_dir):
    return risk.calibration_error(calib(spark, sf_dir), "p", "y").select(rounded(F.col("ece")).alias("ece"))


@query(f"WITH c AS ({CALIB}), b AS (SELECT greatest(CAST(ceil(p * 10) AS INT) - 1, 0) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM c GROUP BY 1) SELECT CAST(x.bin AS INT) AS bin, coalesce(n, 0) AS n, {r6('coalesce(mp, 0)', 'mean_p')}, {r6('coalesce(my, 0)', 'mean_y')} FROM range(10) x(bin) LEFT JOIN b ON x.bin = b.bin")
def reliability(spark, sf_dir):
    r = risk.reliability(calib(spark, sf_dir), "p", "y")
    return r.select("bin", "n", rounded(F.col("mean_p")).alias("mean_p"), rounded(F.col("mean_y")).alias("mean_y"))


@query(
    f"""WITH RECURSIVE c AS ({CALIB}), f AS (SELECT 0 AS step, CAST(1 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b UNION ALL
    SELECT step + 1, a - (g0 * (s4 + 1e-6) - g1 * s3) / ((s2 + 1e-6) * (s4 + 1e-6) - s3 * s3), b - ((s2 + 1e-6) * g1 - s3 * g0) / ((s2 + 1e-6) * (s4 + 1e-6) - s3 * s3) FROM (
        SELECT step, a, b, sum((q - y) * p) + 1e-6 * a AS g0, sum(q - y) + 1e-6 * b AS g1, sum(w * p * p) AS s2, sum(w * p) AS s3, sum(w) AS s4
        FROM (SELECT *, greatest(q * (1 - q), 1e-9) AS w FROM (SELECT step, a, b, p, y, 1 / (1 + exp(-(a * p + b))) AS q FROM f, c WHERE step < 25)) GROUP BY step, a, b))
    SELECT {r6('a', 'a', 5)}, {r6('b', 'b', 5)}, {r6('avg(pow(1 / (1 + exp(-(a * p + b))) - y, 2))', 'brier_after')}, {r6('avg(pow(p - y, 2))', 'brier_before')} FROM (SELECT a, b FROM f ORDER BY step DESC LIMIT 1), c GROUP BY a, b"""
)
def platt(spark, sf_dir):
    c = calib(spark, sf_dir)
    m = risk.Platt().fit(c, "p", "y")
    r = lambda x, name, d=6: rounded(x, d).alias(name)
    return c.agg(r(F.lit(m.a), "a", 5), r(F.lit(m.b), "b", 5), r(risk.brier(m.apply(F.col("p")), F.col("y")), "brier_after"), r(risk.brier(F.col("p"), F.col("y")), "brier_before"))


@query(
    f"""WITH c AS ({CALIB}), x AS (SELECT p AS x, sum(y) AS s, count(*) AS n, row_number() OVER (ORDER BY p) AS i FROM c GROUP BY p), u AS (SELECT *, sum(s) OVER (ORDER BY i) AS su, sum(n) OVER (ORDER BY i) AS nu FROM x),
    m AS (SELECT j.i AS j, k.i AS k, (k.su - j.su + j.s) / (k.nu - j.nu + j.n) AS m FROM u j JOIN u k ON j.i <= k.i), a AS (SELECT j, k AS i, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS least FROM m),
    y AS (SELECT i, max(least) AS y FROM a GROUP BY i) SELECT {r6('max(x)', 'x', 5)}, {r6('y', 'y')} FROM y JOIN x USING (i) GROUP BY y"""
)
def isotonic(spark, sf_dir):
    """The steps of the calibration: the greatest of those below j of the least mean from there to k."""
    c = calib(spark, sf_dir)
    m = risk.Isotonic().fit(c, "p", "y")
    return spark.createDataFrame(m.knots, "x double, y double").select(rounded(F.col("x"), 5).alias("x"), rounded(F.col("y")).alias("y"))


DAILY = "d AS (SELECT l_suppkey AS k, CAST(epoch(l_shipdate) / 86400 AS BIGINT) AS day, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY day) AS i, count(*) OVER (PARTITION BY k) AS n FROM d)"


def daily(spark, sf_dir):
    """Quantity shipped a day by a supplier."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("k"), F.floor(micros("l_shipdate") / 86_400_000_000).alias("day")).agg(F.sum("l_quantity").alias("v"))


@query(
    f"""WITH RECURSIVE {DAILY}, f AS (SELECT k, i, v AS level, CAST(NULL AS DOUBLE) AS slope FROM g WHERE i = 1 UNION ALL
    SELECT g.k, g.i, 0.4 * g.v + 0.6 * (level + coalesce(slope, g.v - level)), 0.2 * (0.4 * g.v + 0.6 * (level + coalesce(slope, g.v - level)) - level) + 0.8 * coalesce(slope, g.v - level) FROM f JOIN g ON g.k = f.k AND g.i = f.i + 1)
    SELECT f.k, CAST(h AS INT) AS h, {r6('level + slope * h', 'predicted', 5)} FROM f JOIN (SELECT k, max(i) AS i FROM g GROUP BY k) l ON f.k = l.k AND f.i = l.i, range(1, 13) x(h)"""
)
def holt_forecast(spark, sf_dir):
    return FC.holt(daily(spark, sf_dir), "k", ["day"], "v", 12).select("k", "h", rounded(F.col("predicted"), 5).alias("predicted"))


@query(
    f"""WITH RECURSIVE {DAILY}, l AS (SELECT k, regr_slope(v, i - 1) AS b, regr_intercept(v, i - 1) AS a, max(n) AS n FROM g GROUP BY k), t AS (SELECT g.k, g.i, 2 * g.v - (a + b * (g.i - 1)) AS x FROM g JOIN l USING (k)),
    f AS (SELECT k, i, x AS m FROM t WHERE i = 1 UNION ALL SELECT t.k, t.i, 0.5 * t.x + 0.5 * m FROM f JOIN t ON t.k = f.k AND t.i = f.i + 1)
    SELECT l.k, CAST(h AS INT) AS h, {r6('0.5 * (a + b * (n - 1 + h)) + 0.5 * m', 'predicted', 5)} FROM l JOIN f ON f.k = l.k AND f.i = l.n, range(1, 13) x(h)"""
)
def theta_forecast(spark, sf_dir):
    return FC.theta(daily(spark, sf_dir), "k", ["day"], "v", 12).select("k", "h", rounded(F.col("predicted"), 5).alias("predicted"))


@query(
    f"""WITH {DAILY}, p AS (SELECT k, v AS y, lag(v) OVER (PARTITION BY k ORDER BY day) AS x FROM d), c AS (SELECT k, least(0.999, greatest(-0.999, covar_pop(x, y) / var_pop(x))) AS phi, avg(x) AS mx, avg(y) AS my FROM p WHERE x IS NOT NULL GROUP BY k), l AS (SELECT k, arg_max(v, day) AS z FROM d GROUP BY k)
    SELECT c.k, CAST(h AS INT) AS h, {r6('(my - phi * mx) * (1 - pow(phi, h)) / (1 - phi) + pow(phi, h) * z', 'predicted', 5)} FROM c JOIN l USING (k), range(1, 13) x(h)"""
)
def ar1_forecast(spark, sf_dir):
    return FC.ar1(daily(spark, sf_dir), "k", ["day"], "v", 12).select("k", "h", rounded(F.col("predicted"), 5).alias("predicted"))


@query(f"WITH {DAILY} SELECT k, {r6('regr_slope(v, i - 1)', 'slope')}, {r6('regr_intercept(v, i - 1)', 'intercept', 5)} FROM g GROUP BY k")
def ols_trend(spark, sf_dir):
    t = FC._trend(daily(spark, sf_dir), "k", ["day"], "v").select("k", "slope", "intercept").distinct()
    return t.select("k", rounded(F.col("slope")).alias("slope"), rounded(F.col("intercept"), 5).alias("intercept"))


@query(
    f"""WITH RECURSIVE {DAILY}, ma AS (SELECT k, i, n, v, (i - 1) % 7 AS p, CASE WHEN count(*) OVER w = 7 THEN avg(v) OVER w END AS ma FROM g WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    o AS (SELECT k, p, avg(v - ma) AS off FROM ma WHERE ma IS NOT NULL GROUP BY k, p), se AS (SELECT k, p, off - avg(off) OVER (PARTITION BY k) AS s FROM o), y AS (SELECT ma.k, i, n, v - CASE WHEN n >= 14 THEN coalesce(s, 0) ELSE 0 END AS v FROM ma LEFT JOIN se ON se.k = ma.k AND se.p = ma.p),
    f AS (SELECT k, i, v AS level, CAST(NULL AS DOUBLE) AS slope FROM y WHERE i = 1 UNION ALL
    SELECT y.k, y.i, 0.4 * y.v + 0.6 * (level + coalesce(slope, y.v - level)), 0.2 * (0.4 * y.v + 0.6 * (level + coalesce(slope, y.v - level)) - level) + 0.8 * coalesce(slope, y.v - level) FROM f JOIN y ON y.k = f.k AND y.i = f.i + 1),
    l AS (SELECT f.k, f.level, f.slope, n FROM f JOIN y ON y.k = f.k AND y.i = f.i WHERE f.i = n)
    SELECT l.k, CAST(h AS INT) AS h, {r6('level + slope * h + CASE WHEN n >= 14 THEN coalesce(s, 0) ELSE 0 END', 'predicted', 5)} FROM l CROSS JOIN range(1, 13) x(h) LEFT JOIN se ON se.k = l.k AND se.p = (n + (h - 1) % 7) % 7"""
)
def seasonal_forecast(spark, sf_dir):
    """Holt on the series without its weekly season, and the season again."""
    return FC.seasonal(daily(spark, sf_dir), "k", ["day"], "v", 12).select("k", "h", rounded(F.col("predicted"), 5).alias("predicted"))


MEMBERS = "m AS (SELECT l_suppkey AS k, CAST(1 + l_linenumber % 7 AS INT) AS h, CAST(l_orderkey % 3 AS VARCHAR) AS method, avg(l_quantity) AS predicted, avg(l_quantity) - 5 AS lower, avg(l_quantity) + 5 AS upper FROM lineitem GROUP BY 1, 2, 3)"
POOL = f"{MEMBERS}, p AS (SELECT k, h, 0.5 * avg(predicted) + 0.5 * median(predicted) AS predicted, min(lower) AS lo, max(upper) AS hi, stddev_pop(predicted) AS sd FROM m GROUP BY k, h), a AS (SELECT k, least(1, greatest(0, 1 - avg(sd) / greatest(avg(abs(predicted)), 1e-9))) AS agreement FROM p GROUP BY k), e AS (SELECT k, h, predicted, least(lo, predicted - sd) AS lower, greatest(hi, predicted + sd) AS upper, agreement FROM p JOIN a USING (k))"


def members(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q = F.avg("l_quantity")
    return li.groupBy(F.col("l_suppkey").alias("k"), (1 + F.col("l_linenumber") % 7).cast("int").alias("h"), (F.col("l_orderkey") % 3).cast("string").alias("method")).agg(q.alias("predicted"), (q - 5).alias("lower"), (q + 5).alias("upper"))


@query(f"WITH {POOL} SELECT k, h, {r6('predicted', 'predicted')}, {r6('lower', 'lower')}, {r6('upper', 'upper')}, {r6('agreement', 'agreement')} FROM e")
def ensemble_pool(spark, sf_dir):
    out = FC.ensemble(members(spark, sf_dir), ["k"])
    return out.select("k", "h", *(rounded(F.col(c)).alias(c) for c in ("predicted", "lower", "upper", "agreement")))


@query(
    f"""WITH {POOL}, l AS (SELECT *, coalesce(lag(predicted) OVER w, 20.0) AS b FROM e WINDOW w AS (PARTITION BY k ORDER BY h)),
    c AS (SELECT k, h, CASE WHEN predicted >= 27 THEN (h - 1 + CASE WHEN predicted = b THEN 1 ELSE least(1, greatest(0, (27 - b) / (predicted - b))) END) * 20 END AS t FROM l)
    SELECT k, round(arg_min(t, h) FILTER (t IS NOT NULL) + 3.1e-8, 5) + 0.0 AS eta FROM c GROUP BY k"""
)
def tti_crossing(spark, sf_dir):
    """When the pooled trajectory first reaches 27, from 20 now."""
    pool = FC.ensemble(members(spark, sf_dir), ["k"]).withColumn("now", F.lit(20.0))
    return FC.crossing(pool, ["k"], "now", F.lit(27.0), seconds=20.0).select("k", rounded(F.col("eta"), 5).alias("eta"))


@query(f"WITH {DAILY}, w AS (SELECT k, v, i FROM g WHERE i > n - 30), s AS (SELECT a.k, (b.v - a.v) / (b.i - a.i) AS s FROM w a JOIN w b ON a.k = b.k AND a.i < b.i) SELECT k, {r6('median(s)', 'slope')} FROM s GROUP BY k")
def theil_sen(spark, sf_dir):
    return FC.theil_sen(daily(spark, sf_dir), "k", ["day"], "v").select("k", rounded(F.col("slope")).alias("slope"))


@query(f"WITH {POOL}, c AS (SELECT k, h, CASE WHEN predicted > 26 THEN predicted END AS eta, agreement * h / 8 AS confidence FROM e) SELECT k, coalesce(arg_min(h, {{'a': eta, 'b': -confidence}}) FILTER (eta IS NOT NULL), arg_max(h, confidence)) AS h FROM c GROUP BY k")
def pick_tti(spark, sf_dir):
    """The soonest impact of several estimates; without any, the most confident."""
    pool = FC.ensemble(members(spark, sf_dir), ["k"])
    c = pool.select("k", "h", F.when(F.col("predicted") > 26, F.col("predicted")).alias("eta"), (F.col("agreement") * F.col("h") / 8).alias("confidence"))
    soonest = F.min_by("h", F.when(F.col("eta").isNotNull(), F.struct("eta", -F.col("confidence"))))
    return c.groupBy("k").agg(F.coalesce(soonest, F.max_by("h", "confidence")).alias("h"))


@query(
    f"""WITH RECURSIVE {DAILY}, i0 AS (SELECT k, avg(v) FILTER (i <= 7) AS m1, avg(v) FILTER (i BETWEEN 8 AND 14) AS m2, list(v ORDER BY i) FILTER (i <= 7) AS head, max(n) AS n FROM g GROUP BY k),
    z AS (SELECT k, n, 0 AS i, m1 AS level, (m2 - m1) / 7 AS slope, list_transform(head, lambda x: x - m1) AS sea FROM i0),
    f AS (SELECT k, n, i, level, slope, sea FROM z UNION ALL
        SELECT f.k, f.n, f.i + 1, a.level, 0.1 * (a.level - f.level) + 0.9 * f.slope, list_transform(f.sea, lambda x, j: CASE WHEN j = f.i % 7 + 1 THEN 0.1 * (g.v - a.level) + 0.9 * x ELSE x END)
        FROM f JOIN g ON g.k = f.k AND g.i = f.i + 1 CROSS JOIN LATERAL (SELECT 0.3 * (g.v - f.sea[f.i % 7 + 1]) + 0.7 * (f.level + f.slope) AS level) a)
    SELECT k, CAST(h AS INT) AS h, {r6('level + h * slope + sea[(h - 1) % 7 + 1]', 'predicted', 5)} FROM f, range(1, 13) x(h) WHERE i = n AND n >= 14"""
)
def holt_winters(spark, sf_dir):
    """Seasonal forecast, seven points a season."""
    from tidemark.operators.fold import keyed_fold

    d = daily(spark, sf_dir)
    f = keyed_fold(d, ["k"], ["day"], lambda: FC.WintersState(7), "level double, slope double, seasonal array<double>")
    last = f.groupBy("k").agg(F.max_by(F.struct("level", "slope", "seasonal"), "day").alias("s"), F.count("*").alias("n")).select("k", "s.*", "n")
    h = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("h")
    last = last.where(F.size("seasonal") > 0)
    return last.select("*", h).select("k", "h", rounded(F.col("level") + F.col("h") * F.col("slope") + F.coalesce(F.get("seasonal", ((F.col("h") - 1) % 7).cast("int")), F.lit(0.0)), 5).alias("predicted"))


@query(
    f"""WITH RECURSIVE {DAILY}, p AS (SELECT k, v, i, n - 12 AS n FROM g WHERE i <= n - 12), l AS (SELECT k, regr_slope(v, i - 1) AS b, regr_intercept(v, i - 1) AS a, max(n) AS n FROM p GROUP BY k), t AS (SELECT p.k, p.i, 2 * p.v - (a + b * (p.i - 1)) AS x FROM p JOIN l USING (k)),
    f AS (SELECT k, i, x AS m FROM t WHERE i = 1 UNION ALL SELECT t.k, t.i, 0.5 * t.x + 0.5 * m FROM f JOIN t ON t.k = f.k AND t.i = f.i + 1),
    e AS (SELECT g.k, avg(abs(0.5 * (a + b * (g.i - 1)) + 0.5 * m - g.v)) AS mae FROM g JOIN l ON l.k = g.k AND g.i > l.n JOIN f ON f.k = l.k AND f.i = l.n GROUP BY g.k),
    nv AS (SELECT k, avg(abs(v - w)) AS naive FROM (SELECT k, v, lag(v) OVER (PARTITION BY k ORDER BY i) AS w FROM p) GROUP BY k) SELECT e.k, {r6('mae / greatest(naive, 1e-9)', 'mase', 5)} FROM e JOIN nv USING (k)"""
)
def backtest(spark, sf_dir):
    return FC.backtest_mase(daily(spark, sf_dir), "k", ["day"], "v", FC.theta).select("k", rounded(F.col("mase"), 5).alias("mase"))


TREND = f"""{DAILY}, w AS (SELECT k, v, i, n FROM g WHERE i > n - 30), s AS (SELECT a.k, median((b.v - a.v) / (b.i - a.i)) AS slope FROM w a JOIN w b ON a.k = b.k AND a.i < b.i GROUP BY a.k), tr AS (SELECT s.k, slope, v AS last FROM s JOIN w ON w.k = s.k AND w.i = w.n),
    te AS (SELECT k, CASE WHEN abs(slope) < 1e-12 THEN NULL WHEN (60 - last) / slope <= 0 THEN CASE WHEN last >= 60 THEN 0 END WHEN slope > 0 THEN (60 - last) / slope * 20 END AS eta FROM tr)"""


@query(
    f"""WITH {POOL}, l AS (SELECT *, coalesce(lag(predicted) OVER (PARTITION BY k ORDER BY h), 20.0) AS b FROM e), c AS (SELECT k, h, CASE WHEN predicted >= 27 THEN (h - 1 + CASE WHEN predicted = b THEN 1 ELSE least(1, greatest(0, (27 - b) / (predicted - b))) END) * 20 END AS t FROM l),
    tc AS (SELECT k, arg_min(t, h) FILTER (t IS NOT NULL) AS eta FROM c GROUP BY k), {TREND.replace("d AS (", "dd AS (", 1).replace("FROM d)", "FROM dd)", 1)}
    SELECT tc.k, CASE WHEN tc.eta IS NOT NULL THEN 'trajectory' WHEN te.eta IS NOT NULL THEN 'trend' ELSE 'healthy' END AS method, round(coalesce(tc.eta, te.eta) + 3.1e-8, 5) + 0.0 AS eta FROM tc LEFT JOIN te USING (k)"""
)
def impact_facade(spark, sf_dir):
    """The trajectory's crossing of 27; else where the trend of days reaches 60; else healthy."""
    pool = FC.ensemble(members(spark, sf_dir), ["k"]).withColumn("now", F.lit(20.0))
    cross = FC.crossing(pool, ["k"], "now", F.lit(27.0), seconds=20.0)
    trend = FC.extrapolated(FC.theil_sen(daily(spark, sf_dir), "k", ["day"], "v"), "k", F.lit(60.0), seconds=20.0)
    out = FC.first_estimate("k", [("trajectory", cross), ("trend", trend)])
    return out.select("k", "method", rounded(F.col("eta"), 5).alias("eta"))


@query(
    f"""WITH {MEMBERS.replace("m AS (", "m0 AS (", 1)}, m AS (SELECT *, CASE method WHEN '0' THEN 0.5 WHEN '1' THEN 2.0 END AS mase FROM m0), w AS (SELECT *, coalesce(1 / (mase + 1e-3), 1.0) AS w FROM m)
    SELECT k, h, {r6('0.5 * sum(w * predicted) / sum(w) + 0.5 * median(predicted)', 'predicted')} FROM w GROUP BY k, h"""
)
def weighted_pool(spark, sf_dir):
    """Members of an ensemble weigh by the inverse of what they missed in a backtest; one that has none weighs 1."""
    m = members(spark, sf_dir).withColumn("mase", F.when(F.col("method") == "0", 0.5).when(F.col("method") == "1", 2.0))
    return FC.ensemble(m, ["k"]).select("k", "h", rounded(F.col("predicted")).alias("predicted"))


@query()
def tested_ensemble(spark, sf_dir):
    """Holt, theta and AR(1) forecasts of each supplier, pooled by their backtests."""
    d = daily(spark, sf_dir)
    models = {"ewma_holt": FC.holt, "theta": FC.theta, "ar1": FC.ar1}
    points = None
    for model in models.values():
        p = model(d, "k", ["day"], "v", 6)
        points = p if points is None else points.unionByName(p)
    return FC.ensemble(FC.tested(points, d, "k", ["day"], "v", models), ["k"]).select("k", "h", "predicted", "lower", "upper", "agreement")
