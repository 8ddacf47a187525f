"""Relational operators: joins on time and topology, deduplication, collapses, unpivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut

# The metric of a routing event.
ROUTING_METRICS = {
    "bgp_update": "bgp_update_count", "bgp_withdraw": "bgp_withdraw_count", "path_change": "bgp_path_change", "adjacency_down": "ospf_adjacency_flap",
    "adjacency_up": "ospf_adjacency_flap", "spf_run": "ospf_spf_runs", "lsa_flood": "ospf_lsa_count",
}


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; only that row's columns are kept by Spark's group limit before the shuffle's sort."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """df with name, 1, 2, ... in a total order, without a window over all rows.

    A sort by ranges deals the rows to partitions in order; the driver adds up a count for each partition.
    """
    placed = cut(df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()))
    part, within = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        offsets.append((r.p, before))
        before += r.n
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part long, __before long"))  # a row for each partition
    return placed.join(table, part == F.col("__part")).withColumn(name, F.col("__before") + within + 1).drop("__place", "__part", "__before")


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], what: Column, name: str) -> DataFrame:
    """df with name, the sum of what over a key's rows up to this one, for keys of any size.

    A sort by ranges deals the rows to partitions in order; sums of a key's partitions, few rows, give what lies
    before, and running sums within a partition the rest.  keys and order together must be unique.
    """
    placed = cut(df.withColumn("__what", what).orderBy(*keys, *order).withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy(*keys, "__part").agg(F.sum("__what").alias("__sum"))
    before = cut(sums.withColumn("__before", F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__sum")).drop("__sum"))
    within = F.sum("__what").over(Window.partitionBy(*keys, "__part").orderBy(*order))
    return placed.withColumn("__within", within).join(before, [*keys, "__part"]).withColumn(name, F.col("__before") + F.col("__within")).drop("__what", "__part", "__before", "__within")


def dedup_earliest(events: DataFrame, keys: Sequence[str], ts: str, seq: str) -> DataFrame:
    """The earliest event of each key (smallest seq of equal times) with how many there were.

    Aggregated with partial minima, so a hot key is a row per task in the shuffle.
    """
    rest = [c for c in events.columns if c not in keys]
    least = F.min_by(F.struct(*rest), F.struct(ts, seq)).alias("__e")
    return events.groupBy(*keys).agg(least, F.count("*").alias("n_raw")).select(*keys, "__e.*", "n_raw")


def collapse_best(df: DataFrame, key: str, by: Sequence[str], seq: str) -> DataFrame:
    """The row of each key with the greatest values of ``by``; of equals the first."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*by, -F.col(seq))).alias("__e")).select(key, "__e.*")


def dominant(df: DataFrame, key: str, value: str, seq: str, none: str) -> DataFrame:
    """The most frequent value of each key but ``none``; of equals the one seen first."""
    counts = df.where(F.col(value) != none).groupBy(key, value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))


def unpivot(wide: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A row for each metric of a wide record that is not null: ids, metric, value."""
    return wide.unpivot(list(ids), list(values), "metric", "value").where(F.col("value").isNotNull())


def asof_latest(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """left with the last value of right at or before left_ts, without a range join: union and carry forward.

    Of right rows at the same time the one with the greatest value counts.
    """
    marked = left.select(key, F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"))
    fed = right.select(key, F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(marked.schema["__l"].dataType).alias("__l"), F.col(value).alias("__v"))
    w = Window.partitionBy(key).orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.unionByName(fed).withColumn(value, F.last("__v", ignorenulls=True).over(w))
    return carried.where("__side = 1").select("__l.*", value)


def interval_join(points: DataFrame, spans: DataFrame, ts: str, start: str, end: str, *, width: int, on: Sequence[str] = (), closed: bool = False) -> DataFrame:
    """points within spans (start <= ts < end, or <= end), by an equi-join on time bins.

    width should be about the length of a span: a span is put into each bin that it touches, a point
    into one, so no pair is found twice.
    """
    spread = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    binned = points.withColumn("__bin", F.floor(F.col(ts) / width))
    within = (F.col(ts) >= F.col(start)) & ((F.col(ts) <= F.col(end)) if closed else (F.col(ts) < F.col(end)))
    return binned.join(spread, ["__bin", *on]).where(within).drop("__bin")


def near_pairs(events: DataFrame, ts: str, seq: str, window: int, columns: Sequence[str], on: Sequence[str] = ()) -> DataFrame:
    """Pairs (a_*, b_*) of events, a before b in seq, at most ``window`` apart, by an equi-join on bins of that width."""
    side = lambda p: events.select(*on, F.floor(F.col(ts) / window).alias("__bin"), *(F.col(c).alias(f"{p}_{c}") for c in dict.fromkeys([ts, seq, *columns])))
    b = side("b").withColumn("__bin", F.explode(F.array(F.col("__bin") - 1, F.col("__bin"), F.col("__bin") + 1)))
    return side("a").join(b, ["__bin", *on]).where((F.col(f"a_{seq}") < F.col(f"b_{seq}")) & (F.abs(F.col(f"a_{ts}") - F.col(f"b_{ts}")) <= window)).drop("__bin")


def adjacent_links(events: DataFrame, keys: Sequence[str], ts: str, seq: str, window: int) -> DataFrame:
    """(a, b): each event and the one before it among those of its key, where they are at most ``window`` apart.

    Their components are those of all pairs at most ``window`` apart, from as many links as events.  Events lie in
    bins of that width, so a key of any size is many groups; the first of a bin may be linked to the last of the bin
    before.
    """
    binned = events.select(*keys, F.col(ts).alias("__t"), F.col(seq).alias("__s"), F.floor(F.col(ts) / window).alias("__bin"))
    w = Window.partitionBy(*keys, "__bin").orderBy("__t", "__s")
    inside = binned.select(F.col("__s").alias("a"), F.lag("__s").over(w).alias("b"), (F.col("__t") - F.lag("__t").over(w)).alias("gap"))
    ends = binned.groupBy(*keys, "__bin").agg(F.min(F.struct("__t", "__s")).alias("first"), F.max(F.struct("__t", "__s")).alias("last"))
    after = ends.select(*keys, (F.col("__bin") + 1).alias("__bin"), "last").join(ends.select(*keys, "__bin", "first"), [*keys, "__bin"])
    across = after.select(F.col("first.__s").alias("a"), F.col("last.__s").alias("b"), (F.col("first.__t") - F.col("last.__t")).alias("gap"))
    return inside.unionByName(across).where(F.col("gap") <= window).select("a", "b")


def nearest_links(events: DataFrame, marked: Column, ts: str, seq: str, window: int) -> DataFrame:
    """(a, b): each event that is not marked and the nearest marked ones before and after it, at most ``window`` apart."""
    some = events.select(F.col(ts).alias("__t"), F.col(seq).alias("__s"), marked.alias("__m"), F.floor(F.col(ts) / window).alias("__bin"))
    near = some.where("__m").withColumn("__bin", F.explode(F.array(F.col("__bin") - 1, F.col("__bin"), F.col("__bin") + 1)))
    both = near.unionByName(some.where("not __m"))
    mark = F.when(F.col("__m"), F.struct("__t", "__s"))
    w = Window.partitionBy("__bin").orderBy("__t", "__s")
    before, after = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.last(mark, ignorenulls=True).over(Window.partitionBy("__bin").orderBy(F.desc("__t"), F.desc("__s")).rowsBetween(Window.unboundedPreceding, -1))
    ends = both.withColumns({"__before": before, "__after": after}).where("not __m").select(F.col("__s").alias("a"), "__t", F.explode(F.array("__before", "__after")).alias("n"))
    return ends.where(F.abs(F.col("n.__t") - F.col("__t")) <= window).select("a", F.col("n.__s").alias("b"))


def map_to_node(entities: DataFrame, nodes: DataFrame, entity: str = "entity") -> DataFrame:
    """entity, node: the node of that name, else of its longest prefix of segments, else the first node that begins with its first two.

    nodes has id and node_seq.  Candidates are at most as many as an id has segments; each is an equi-join.
    """
    parts = F.split(entity, ":")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), ":").alias("id")))
    ids = entities.select(entity).distinct()
    exact = ids.select(entity, F.inline(prefixes)).join(nodes.select("id"), "id").groupBy(entity).agg(F.max_by("id", "depth").alias("node"))
    stem = lambda c: F.array_join(F.slice(F.split(c, ":"), 1, 2), ":")
    stems = nodes.groupBy(stem(F.col("id")).alias("stem")).agg(F.min_by("id", "node_seq").alias("by_stem"))
    out = ids.join(exact, entity, "left").withColumn("stem", stem(F.col(entity))).join(stems, "stem", "left")
    return out.select(entity, F.coalesce("node", "by_stem").alias("node"))


def touched(flows: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Flows whose source or target is in scope (column id): two semi-joins, the second without the first's, so no disjunctive join."""
    src, dst = sources.select(F.col("id").alias("src")).distinct(), targets.select(F.col("id").alias("dst")).distinct()
    return flows.join(src, "src", "left_semi").unionByName(flows.join(dst, "dst", "left_semi").join(src, "src", "left_anti"))


def flow_rollup(flows: DataFrame, keys: Sequence[str], us: str, seconds: int) -> DataFrame:
    """Bytes and packets of flows per key and tumbling window."""
    return flows.groupBy(F.floor(F.col(us) / (seconds * 1_000_000)).alias("window"), *keys).agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.count("*").alias("n"))


def ordered_union(first: DataFrame, second: DataFrame, group: str, name: str, order: str, most: int) -> DataFrame:
    """Signals of two lists: each name once, the first list's before the second's, at most ``most`` of a group."""
    both = first.withColumn("__list", F.lit(0)).unionByName(second.withColumn("__list", F.lit(1)))
    once = first_by(both, [group, name], ["__list", F.desc(order)])
    w = Window.partitionBy(group).orderBy("__list", F.desc(order), name)
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("__list")
