"""Resharding by minimum-cost flow.

Old shards have sizes, new shards capacities; a byte that stays in the shard of its number costs
nothing and a byte that moves costs 1.  Successive shortest paths solve the flow on the driver (its
graph has a node for each shard).  Each old shard is then one stretch of bytes, cut where the flow
says: what stays, then what goes to each other shard.  A document goes where the middle of its bytes
lies.  The cuts fall within documents, so shards miss their capacity by a few halves of documents;
``settle`` moves single documents of a bounded sample between shards to even that out.

Stretches are laid out without ordering a shard in one task: rows are hashed to BLOCKS blocks, sums
of blocks give the offsets, and rows are ordered within a block.  Rows equal in doc_id and text go
through all this as one with a number of copies, however many there are, and become rows again when
files are written, at most CHUNK of them by a step.

The law is ``bytes``.  The flow moves the fewest bytes to capacities of bytes, and a group of equal
texts under different doc_ids is so many bytes like any others: it may be cut between shards, since
to keep groups whole would move more bytes or miss the capacities by a group that is larger than one.

Defined results: a null text is empty (size 1, checksum 0); very long texts are one row like others;
repeated rows are rows of their own; rows without doc_id take part; a null old shard counts as shard
0; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import first_of, identity, scratch, utf8_size, written

BLOCKS = 1024
CHUNK = 4096
LAW = "bytes"


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost) of a cheapest maximum flow."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for a, b, c, w in edges:
        graph[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        graph[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)
    potential = [0] * n
    while True:
        dist, via = [None] * n, [-1] * n
        dist[source], heap = 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in graph[a]:
                if cap[e] > 0:
                    b, nd = to[e], d + cost[e] + potential[a] - potential[to[e]]
                    if dist[b] is None or nd < dist[b]:
                        dist[b], via[b] = nd, e
                        heapq.heappush(heap, (nd, b))
        if dist[sink] is None:
            return [cap[2 * i + 1] for i in range(len(edges))]
        potential = [p + (d or 0) for p, d in zip(potential, dist)]
        push, b = None, sink
        while b != source:
            push, b = min(cap[via[b]], push if push is not None else cap[via[b]]), to[via[b] ^ 1]
        b = sink
        while b != source:
            cap[via[b]] -= push
            cap[via[b] ^ 1] += push
            b = to[via[b] ^ 1]


def transfers(old: list[int], new: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j, the fewest of them moved (i != j).  Capacities hold all bytes together."""
    if sum(new) < sum(old):
        raise ValueError("the new shards hold less than the old ones")
    a, b = len(old), len(new)
    edges = [(0, 1 + i, s, 0) for i, s in enumerate(old)] + [(1 + a + j, 1 + a + b, s, 0) for j, s in enumerate(new)]
    inner = [(i, j) for i in range(a) for j in range(b)]
    edges += [(1 + i, 1 + a + j, old[i], int(i != j)) for i, j in inner]
    flow = min_cost_flow(a + b + 2, edges, 0, a + b + 1)[a + b :]
    return {ij: f for ij, f in zip(inner, flow) if f}


def even(total: int, n: int) -> list[int]:
    return [total // n + (j < total % n) for j in range(n)]


KEY = ["h1", "h2"]


def _columns() -> tuple[Column, Column]:
    """doc_id, and the text with null as empty."""
    return F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))


def units(docs: DataFrame, old: Column) -> DataFrame:
    """h1 and h2 (identity of doc_id and text), old, doc_id, size, text_crc32, block, copies; equal rows of an old shard together."""
    doc_id, text = _columns()
    rows = docs.select(*identity(doc_id, text), F.coalesce(old, F.lit(0)).cast("int").alias("old"), doc_id.alias("doc_id"), (utf8_size(text) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    once = rows.groupBy(*KEY, "old").agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "text_crc32")), F.count("*").alias("copies"))
    return once.withColumn("block", F.pmod("h1", F.lit(BLOCKS)).cast("int"))


def _offsets(rows: DataFrame, by: str, what: Column) -> DataFrame:
    """by, block, at: sum of what over the blocks before, within by; a row of by holds its BLOCKS sums."""
    sums = rows.groupBy(by, "block").agg(F.sum(what).alias("n")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("block", "n"))).alias("s"))
    before = lambda i: F.aggregate(F.slice("s", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return sums.select(by, F.inline(F.transform("s", lambda x, i: F.struct(x["block"].alias("block"), before(i).alias("at")))))


def _started(rows: DataFrame, by: str, what: Column) -> DataFrame:
    """rows with at: the sum of what over the rows before, within by."""
    order = Window.partitionBy(by, "block").orderBy(*KEY, "old").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(_offsets(rows, by, what), [by, "block"]).withColumn("at", F.col("at") + F.sum(what).over(order) - what)


def assign(rows: DataFrame, n_new: int, capacities: list[int] | None = None) -> tuple[DataFrame, set[int]]:
    """rows with shard, copies split where a cut falls among them, and the numbers of the shards whose content changes."""
    spark = rows.sparkSession
    n_bytes = F.col("size") * F.col("copies")
    sizes = {r.old: r.n for r in rows.groupBy("old").agg(F.sum(n_bytes).alias("n")).collect()}
    old = [sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)]
    flow = transfers(old, capacities or even(sum(old), n_new))
    cuts = []
    for i in range(len(old)):
        at = 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            cuts.append((i, at, at + flow[i, j], j))
            at += flow[i, j]
    segments = F.broadcast(spark.createDataFrame(cuts, "seg_old int, lo long, hi long, shard int"))  # at most shards times shards
    # The middle of copy c lies at at + c size + size / 2; so many copies have theirs before a cut.
    before = lambda cut: F.least(F.col("copies"), F.greatest(F.lit(0), F.expr(f"(2 * {cut} - 2 * at + size - 1) div (2 * size)")))
    placed = _started(rows, "old", n_bytes).join(segments, F.col("old") == F.col("seg_old")).withColumn("copies", before("hi") - before("lo")).where("copies > 0")
    return placed.drop("at", "seg_old", "lo", "hi"), {k for ij in flow if ij[0] != ij[1] for k in ij}


def settle(rows: DataFrame, capacities: list[int], n_sample: int = 256) -> DataFrame:
    """Even out what the cuts left: move documents of a sample of n_sample keys a shard to the shards that lack most."""
    spark = rows.sparkSession
    n_bytes = F.col("size") * F.col("copies")
    have = {r.shard: r.n for r in rows.groupBy("shard").agg(F.sum(n_bytes).alias("n")).collect()}
    over = [have.get(j, 0) - c for j, c in enumerate(capacities)]
    by_key = rows.groupBy("shard", *KEY).agg(F.sum(n_bytes).alias("n"))
    first = Window.partitionBy("shard").orderBy(F.xxhash64("h1"), *KEY)
    sample = by_key.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n_sample).select("shard", *KEY, "n").collect()
    pool = {j: sorted((r.n, r.h1, r.h2) for r in sample if r.shard == j) for j in range(len(over))}
    moves = []
    for _ in range(8 * len(over)):
        a, b = max(range(len(over)), key=over.__getitem__), min(range(len(over)), key=over.__getitem__)
        gap = over[a] - over[b]
        fit = [x for x in pool[a] if x[0] < gap]
        if not fit:
            break
        best = min(fit, key=lambda x: (abs(2 * x[0] - gap), x))
        pool[a].remove(best)
        moves.append((a, *best[1:], b))
        over[a] -= best[0]
        over[b] += best[0]
    table = F.broadcast(spark.createDataFrame(moves, "shard int, h1 long, h2 long, to int"))  # at most 8 a shard
    return rows.join(table, ["shard", *KEY], "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")


def with_slots(rows: DataFrame) -> DataFrame:
    """rows with slot, the place in the shard of their first copy; places are gapless from 0."""
    return _started(rows, "shard", F.col("copies")).withColumnRenamed("at", "slot")


def _copied(rows: DataFrame) -> DataFrame:
    """A row with its slot for each copy."""
    return rows.withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("copies") - 1)))


def rewrite(docs: DataFrame, rows: DataFrame, path: str, shards: set[int]) -> None:
    """Write the files of the given shards below path: shard=j/ with slot, doc_id and text."""
    doc_id, text = _columns()
    texts = first_of(docs.select(*identity(doc_id, text), text.alias("text")), KEY)
    some = rows.where(F.col("shard").isin(sorted(shards))) if shards else rows.limit(0)
    few, many = some.where(F.col("copies") <= CHUNK), some.where(F.col("copies") > CHUNK)
    out = _copied(few.join(texts, KEY))
    if not many.isEmpty():
        # Their texts, one by CHUNK rows at most, are written, so that the chunks of one can be dealt to many tasks.
        own = written(texts.join(many.select(*KEY).distinct(), KEY, "left_semi"), "texts")
        start = F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("copies") - 1, F.lit(CHUNK).cast("long")))
        chunks = many.withColumn("end", F.col("slot") + F.col("copies")).withColumn("slot", start).withColumn("copies", F.least(F.lit(CHUNK), F.col("end") - F.col("slot"))).drop("end")
        out = out.unionByName(_copied(written(chunks, "chunks").join(own, KEY)))
    out.select("shard", "slot", "doc_id", "text").write.partitionBy("shard").parquet(path)


def reshard(docs: DataFrame, n_new: int, old: Column) -> DataFrame:
    """Move documents from their old shards to n_new shards of like bytes.

    Writes the files of the shards that change to the shared folder and returns a row for each
    document, read from those files (and, for shards that stay as they are, from docs): doc_id, size,
    text_crc32, law, shard, slot, grown_shard.
    """
    spark = docs.sparkSession
    rows = written(units(docs, old), "units")
    total = rows.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    placed, changed = assign(rows, n_new)
    final = written(with_slots(settle(written(placed, "placed"), even(total, n_new))), "slots")
    changed |= {r.shard for r in final.where("shard <> old").select("shard").distinct().collect()}
    path = scratch(spark, "shards")
    rewrite(docs, final, path, changed)
    files = spark.read.schema("slot long, doc_id long, text string, shard int").parquet(path)
    text = F.coalesce("text", F.lit(""))
    out = files.select("doc_id", (utf8_size(text) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "shard", "slot")
    if len(changed) < n_new:
        stay = final.where(~F.col("shard").isin(sorted(changed))) if changed else final
        out = out.unionByName(_copied(stay).select("doc_id", "size", "text_crc32", "shard", "slot"))
    return out.withColumns({"law": F.lit(LAW), "grown_shard": F.lit(None).cast("int")})
