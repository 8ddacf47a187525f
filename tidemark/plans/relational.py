"""Projections, joins, aggregations and set operations over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import entity_id, micros, rounded
from tidemark.operators import relational as R
from tidemark.plans.registry import query
from tidemark.plans.views import FLOWS, T, edges, flows, table, telemetry

DAY = 86_400_000_000


@query("SELECT event_id AS seq, 'site' || (user_id % 5) || ':user:' || event_type || ':' || user_id AS entity, CAST(json_extract(props, '$.k') AS BIGINT) AS label FROM events")
def telemetry_project(spark, sf_dir):
    """Entity keys and typed labels of raw events."""
    e = table(spark, sf_dir, "events")
    labels = F.create_map(F.lit("interface"), F.lit(""), F.lit("peer"), F.col("user_id").cast("string"))
    key = entity_id(F.concat(F.lit("site"), (F.col("user_id") % 5).cast("string")), F.lit("user"), F.col("event_type"), labels)
    return e.select(F.col("event_id").alias("seq"), key.alias("entity"), F.get_json_object("props", "$.k").cast("long").alias("label"))


@query("SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'ospf_adjacency_flap' WHEN 'click' THEN 'bgp_update_count' WHEN 'signup' THEN 'bgp_path_change' END AS metric, value FROM events WHERE event_type IN ('error', 'click', 'signup')")
def event_type_map_join(spark, sf_dir):
    """Routing events to metrics; unknown kinds give no row."""
    names = {"error": "adjacency_down", "click": "bgp_update", "signup": "path_change"}
    dim = spark.createDataFrame([(k, R.ROUTING_METRICS[v]) for k, v in names.items()], "event_type string, metric string")
    return table(spark, sf_dir, "events").join(F.broadcast(dim), "event_type").select(F.col("event_id").alias("seq"), "metric", "value")


@query("SELECT l_orderkey, l_linenumber, metric, round(value + 3.1e-08, 5) + 0.0 AS value FROM (SELECT l_orderkey, l_linenumber, unnest(['loss', 'jitter', 'rekey']) AS metric, unnest([l_discount, l_tax, CASE WHEN l_returnflag = 'R' THEN l_quantity END]) AS value FROM lineitem) WHERE value IS NOT NULL")
def wide_to_long_unpivot(spark, sf_dir):
    """A tunnel's loss, jitter and optional rekey interval as rows."""
    wide = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("loss"), F.col("l_tax").alias("jitter"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("rekey"))
    return R.unpivot(wide, ["l_orderkey", "l_linenumber"], ["loss", "jitter", "rekey"]).withColumn("value", rounded(F.col("value"), 5))


@query("SELECT CASE WHEN event_type = 'error' THEN 'SyslogEvent' WHEN event_type IN ('click', 'signup') THEN 'RoutingEvent' ELSE 'TelemetryRecord' END AS kind, count(*) AS n FROM events GROUP BY 1")
def jsonl_type_counts(spark, sf_dir):
    """Records to tagged JSON lines and back, counted by type."""
    from tidemark.sources.records import decode, encode, type_of

    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    kind = F.when(F.col("event_type") == "error", "SyslogEvent").when(F.col("event_type").isin("click", "signup"), "RoutingEvent").otherwise("TelemetryRecord")
    lines = encode(e, kind)
    return decode(lines).groupBy(type_of(F.col("record")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {T} SELECT k, metric, arg_min(seq, {{'a': us, 'b': seq}}) AS seq, arg_min(v, {{'a': us, 'b': seq}}) AS v, count(*) AS n_raw FROM t GROUP BY k, metric")
def dedup_earliest(spark, sf_dir):
    return R.dedup_earliest(telemetry(spark, sf_dir), ["k", "metric"], "us", "seq").select("k", "metric", "seq", "v", "n_raw")


@query(f"WITH {T} SELECT k, arg_max(seq, {{'a': v, 'b': -seq}}) AS seq, max(v) AS v FROM t GROUP BY k")
def max_by_collapse(spark, sf_dir):
    return R.collapse_best(telemetry(spark, sf_dir), "k", ["v"], "seq").select("k", "seq", "v")


@query(f"WITH {T}, c AS (SELECT k, metric, count(*) AS n, min(seq) AS f FROM t WHERE metric <> 'view' GROUP BY k, metric) SELECT k, arg_max(metric, {{'a': n, 'b': -f}}) AS metric, max(n) AS n FROM c GROUP BY k")
def dominant_mode(spark, sf_dir):
    return R.dominant(telemetry(spark, sf_dir), "k", "metric", "seq", "view")


@query(f"WITH {T} SELECT a.seq, (SELECT arg_max(b.v, {{'a': b.us, 'b': b.v}}) FROM t b WHERE b.k = a.k AND b.metric = 'view' AND b.us <= a.us) AS view_v FROM t a WHERE a.metric = 'purchase'")
def asof_join(spark, sf_dir):
    """The last view at or before each purchase."""
    t = telemetry(spark, sf_dir)
    views = t.where("metric = 'view'").select("k", F.col("us").alias("at"), F.col("v").alias("view_v"))
    return R.asof_latest(t.where("metric = 'purchase'").select("k", "seq", "us"), views, "k", "us", "at", "view_v").select("seq", "view_v")


@query(f"WITH {T} SELECT k, arg_max(v, {{'a': us, 'b': seq}}) AS v, max(us) AS us FROM t GROUP BY k")
def asof_latest(spark, sf_dir):
    """The latest snapshot of each entity."""
    return telemetry(spark, sf_dir).groupBy("k").agg(F.max_by("v", F.struct("us", "seq")).alias("v"), F.max("us").alias("us"))


@query(
    f"""WITH {T}, e AS (SELECT seq AS label, k, us - {DAY} AS lo, us AS hi FROM t WHERE metric = 'error')
    SELECT e.label, count(*) AS n, min(t.us) AS first_us, round(max(t.v), 4) + 0.0 AS peak FROM e JOIN t ON t.k = e.k AND t.us >= e.lo AND t.us < e.hi GROUP BY e.label"""
)
def interval_label_join(spark, sf_dir):
    """What each entity did in the day before each of its errors."""
    t = telemetry(spark, sf_dir)
    spans = t.where("metric = 'error'").select("k", F.col("seq").alias("label"), (F.col("us") - DAY).alias("lo"), F.col("us").alias("hi"))
    hits = R.interval_join(t, spans, "us", "lo", "hi", width=DAY, on=["k"])
    return hits.groupBy("label").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), (F.round(F.max("v"), 4) + 0.0).alias("peak"))


@query(f"WITH {FLOWS} SELECT count(*) AS n, round(sum(bytes), 2) AS bytes FROM f WHERE src < 10 OR dst < 20")
def semi_join_flows(spark, sf_dir):
    """Flows that touch a set of sources or targets."""
    hit = R.touched(flows(spark, sf_dir), spark.range(10), spark.range(20))
    return hit.agg(F.count("*").alias("n"), F.round(F.sum("bytes"), 2).alias("bytes"))


@query("SELECT c_custkey, 'dropped' AS verdict FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'valid' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def anti_join_citations(spark, sf_dir):
    """Citations against the closed set of sources."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("verdict", F.lit("valid")).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("verdict", F.lit("dropped")))


@query(f"WITH {T}, a AS (SELECT * FROM t WHERE v > 150) SELECT x.seq AS a_seq, y.seq AS b_seq FROM a x JOIN a y ON x.seq < y.seq AND abs(x.us - y.us) <= 3600000000")
def range_self_join(spark, sf_dir):
    """Pairs of alarms at most an hour apart."""
    return R.near_pairs(telemetry(spark, sf_dir).where("v > 150"), "us", "seq", 3_600_000_000, []).select("a_seq", "b_seq")


@query(
    """WITH n AS (SELECT 'r' || n_regionkey || ':n' || n_nationkey AS id, n_nationkey AS node_seq, n_regionkey AS r FROM nation),
    e AS (SELECT DISTINCT 'r' || (s_nationkey % 7) || ':n' || s_nationkey || ':s' || s_suppkey AS entity FROM supplier)
    SELECT entity, coalesce((SELECT max(id) FROM n WHERE entity = id OR starts_with(entity, id || ':')), (SELECT arg_min(id, node_seq) FROM n WHERE id = split_part(entity, ':', 1) || ':' || split_part(entity, ':', 2))) AS node FROM e"""
)
def prefix_node_map(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    text = lambda c: F.col(c).cast("string")
    nodes = n.select(F.concat(F.lit("r"), text("n_regionkey"), F.lit(":n"), text("n_nationkey")).alias("id"), F.col("n_nationkey").alias("node_seq"))
    ents = s.select(F.concat(F.lit("r"), (F.col("s_nationkey") % 7).cast("string"), F.lit(":n"), text("s_nationkey"), F.lit(":s"), text("s_suppkey")).alias("entity"))
    return R.map_to_node(ents, nodes)


@query(
    """SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION SELECT s_suppkey FROM supplier)
    UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT s_suppkey FROM supplier)
    UNION ALL SELECT 'except', count(*) FROM (SELECT s_suppkey FROM supplier EXCEPT SELECT o_custkey FROM orders)"""
)
def set_ops(spark, sf_dir):
    o, s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    size = lambda name, df: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return size("union", o.union(s).distinct()).unionByName(size("intersect", o.intersect(s))).unionByName(size("except", s.subtract(o)))


@query(f"WITH {T}, s AS (SELECT CASE WHEN v >= 150 THEN 'P1' WHEN v >= 75 THEN 'P2' WHEN v > 0 THEN 'P3' ELSE 'INFO' END AS severity, count(*) AS n FROM t GROUP BY 1) SELECT x.severity, coalesce(n, 0) AS n FROM (VALUES ('P1'), ('P2'), ('P3'), ('INFO')) x(severity) LEFT JOIN s USING (severity)")
def severity_rollup(spark, sf_dir):
    """Counts by severity, zeros kept."""
    sev = F.when(F.col("v") >= 150, "P1").when(F.col("v") >= 75, "P2").when(F.col("v") > 0, "P3").otherwise("INFO")
    n = telemetry(spark, sf_dir).groupBy(sev.alias("severity")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([("P1",), ("P2",), ("P3",), ("INFO",)], "severity string").join(n, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"WITH {FLOWS} SELECT CAST(floor(us / 864e10) AS BIGINT) AS \"window\", vrf, round(sum(bytes), 2) AS bytes, round(sum(packets), 2) AS packets, count(*) AS n FROM f GROUP BY 1, 2")
def flow_rollup(spark, sf_dir):
    out = R.flow_rollup(flows(spark, sf_dir), ["vrf"], "us", 8_640_000)
    return out.withColumns({"bytes": F.round("bytes", 2), "packets": F.round("packets", 2)})


@query(f"WITH {T} SELECT count(DISTINCT k) AS n_keys, count(*) AS n_rows, count(DISTINCT metric) AS n_metrics, count(DISTINCT (k, metric)) AS n_streams FROM t")
def run_stats(spark, sf_dir):
    return telemetry(spark, sf_dir).agg(F.countDistinct("k").alias("n_keys"), F.count("*").alias("n_rows"), F.countDistinct("metric").alias("n_metrics"), F.countDistinct("k", "metric").alias("n_streams"))


@query(f"WITH {T} SELECT metric, round(quantile_cont(v, 0.99) + 3.1e-09, 6) + 0.0 AS p99, round(quantile_cont(v, 0.5) + 3.1e-09, 6) + 0.0 AS p50 FROM t GROUP BY metric")
def exact_quantiles(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy("metric").agg(rounded(F.percentile("v", F.lit(0.99))).alias("p99"), rounded(F.percentile("v", F.lit(0.5))).alias("p50"))


@query(
    f"""WITH {T}, b AS (SELECT metric, ceil(ln(greatest(v, 1e-9)) / ln(1.01 / 0.99)) AS b, count(*) AS c FROM t GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY metric ORDER BY b) AS upto, sum(c) OVER (PARTITION BY metric) AS n, 2 * pow(1.01 / 0.99, b) / (1.01 / 0.99 + 1) AS x FROM b)
    SELECT metric, round(min(x) FILTER (upto > 0.5 * (n - 1)) + 3.1e-8, 5) + 0.0 AS p50, round(min(x) FILTER (upto > 0.99 * (n - 1)) + 3.1e-8, 5) + 0.0 AS p99 FROM r GROUP BY metric"""
)
def sketch_quantiles(spark, sf_dir):
    """Relative-error quantile sketch: counts per logarithmic bucket, mergeable by addition."""
    from tidemark.operators.sketches import log_quantiles

    q = log_quantiles(telemetry(spark, sf_dir), "metric", "v", [0.5, 0.99])
    return q.select("metric", rounded(F.col("p50"), 5).alias("p50"), rounded(F.col("p99"), 5).alias("p99"))


@query(f"WITH {T} SELECT metric, count(DISTINCT k) AS n, true AS close FROM t GROUP BY metric")
def sketch_distinct(spark, sf_dir):
    """Distinct users of each metric, and whether the sketch says so to a tenth."""
    from tidemark.operators.sketches import distinct_sketch

    t = telemetry(spark, sf_dir)
    exact = t.groupBy("metric").agg(F.countDistinct("k").alias("exact"))
    return distinct_sketch(t, "metric", "k").join(exact, "metric").select("metric", F.col("exact").alias("n"), (F.abs(F.col("n") / F.col("exact") - 1) < 0.1).alias("close"))


@query(f"WITH {T}, c AS (SELECT k, count(*) AS n FROM t GROUP BY k) SELECT k, n, true AS covered FROM c")
def sketch_counts(spark, sf_dir):
    """Events of each user, and whether the count-min table's estimate is at least that."""
    from tidemark.operators.sketches import count_min

    c = count_min(telemetry(spark, sf_dir), "k")
    return c.select("k", F.col("exact").alias("n"), (F.col("estimate") >= F.col("exact")).alias("covered"))


@query(f"WITH {T}, b AS (SELECT k, seq, us, v, row_number() OVER (PARTITION BY k ORDER BY us, seq) AS i, count(*) OVER (PARTITION BY k) AS n FROM t), m AS (SELECT *, greatest(5, n // 3) AS h FROM b), a AS (SELECT k, max(n) AS n, quantile_cont(CASE WHEN i <= h THEN v END, 0.5) AS med, max(v) AS peak, arg_max(v, i) AS last FROM m GROUP BY k), d AS (SELECT m.k, quantile_cont(CASE WHEN i <= h THEN abs(v - med) END, 0.5) * 1.4826 AS mad FROM m JOIN a USING (k) GROUP BY m.k) SELECT a.k, a.n >= 12 AND ((abs(peak - med) / greatest(mad, 1e-9) >= 6 AND abs(peak - med) >= 0.5 * 150) OR peak >= 0.5 * 150) AS genuine FROM a JOIN d USING (k)")
def excursion_screen(spark, sf_dir):
    """Which series left their own baseline for real: robust z of the peak against the first third, or half the threshold."""
    from tidemark.operators.screen import excursions

    return excursions(telemetry(spark, sf_dir), "k", "v", ["us", "seq"], threshold=150.0)


@query(f"WITH {FLOWS}, a AS (SELECT src, round(sum(bytes), 2) AS b FROM f GROUP BY src), b AS (SELECT src, round(sum(packets) * 1000, 2) AS b FROM f GROUP BY src), u AS (SELECT 0 AS l, src % 10 AS g, src AS name, b FROM a WHERE src % 3 = 0 UNION ALL SELECT 1, src % 10, src, b FROM b), o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY g, name ORDER BY l, b DESC) = 1) SELECT g, name, CAST(row_number() OVER (PARTITION BY g ORDER BY l, b DESC, name) AS INT) AS rank, b FROM o QUALIFY rank <= 10")
def signal_union(spark, sf_dir):
    """Attributed signals before correlated ones, each once, ten of an incident."""
    f = flows(spark, sf_dir).groupBy("src").agg(F.round(F.sum("bytes"), 2).alias("bytes"), F.round(F.sum("packets") * 1000, 2).alias("packets")).withColumn("g", F.col("src") % 10)
    first = f.where("src % 3 = 0").select("g", F.col("src").alias("name"), F.col("bytes").alias("b"))
    return R.ordered_union(first, f.select("g", F.col("src").alias("name"), F.col("packets").alias("b")), "g", "name", "b", 10).select("g", "name", "rank", "b")
