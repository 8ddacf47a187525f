"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is a share of the mix by its weight, at most ``cap`` times its size.  Complete
epochs come first: as many copies of every document as the target holds whole sizes of the source.
The rest is filled by weighted sampling without replacement: each document's key is an exponential
variate divided by its quality weight, documents are taken in the order of their keys, and their
sizes are summed up to the budget.  A document is taken if the middle of its stretch lies within the
budget, so a source misses its target by half a document at most.

The order within a source is never sorted in one task: keys fall into BUCKETS stretches, sums of
stretches tell in which one the budget ends, and documents of that stretch alone are ordered.  Sources
may be as many as documents: they are numbered by a sort by ranges, and what is left over by caps is
shared out by sums over them; the driver gets sums alone.

Defined results: a null text has size 0; very long texts are counted whole; null is a source of its own,
the last one; repeated rows are taken or left together; a document without doc_id takes part by its text;
an empty table gives an empty result.  Other columns are ignored by ``shares`` and carried along by
``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import n_words, packed, unpacked, written
from tidemark.operators.relational import numbered

BUCKETS = 4096
WEIGHTS = (5.0, 2.0, 1.0)


def quality_weight(text: Column, size: Column) -> Column:
    """Above 0, at most 1: the mean length of words is like that of ordinary prose, few symbols, few repeated lines."""
    text, n = F.coalesce(text, F.lit("")), F.greatest(size, F.lit(1))
    mean = F.length(text) / n
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")) / n
    lines = F.split(text, "\n")
    return 1 / (1 + F.abs(mean - 6) / 6) / (1 + symbols) * F.size(F.array_distinct(lines)) / F.size(lines)


def targets(sizes: DataFrame, *, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sizes (source, n) with target; what a cap leaves over is shared by weight among the others, until none is above.

    A source's target is its weight times a level, or its cap.  The level rises with each round, by which
    more sources meet their caps, until it stays.
    """
    turn = ((F.col("rank") - 1) % len(weights)).cast("int")
    each = numbered(sizes, [F.col("source").asc_nulls_last()]).withColumn("w", F.get(F.array(*map(F.lit, weights)), turn)).select("source", "n", "w")
    each = written(each, "sources")
    total, level, n_capped = each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], 0.0, -1
    while True:
        capped = F.col("w") * level > cap * F.col("n")
        n, at_cap, open_ = each.agg(F.coalesce(F.count_if(capped), F.lit(0)), F.coalesce(F.sum(F.when(capped, F.col("n"))), F.lit(0)), F.sum(F.when(~capped, F.col("w")))).first()
        if n == n_capped or not open_:
            return each.withColumn("target", F.when(capped, cap * F.col("n")).otherwise(F.col("w") * level)).drop("w")
        n_capped, level = n, (share * total - cap * at_cap) / open_


def keyed(docs: DataFrame, seed: int = 11) -> DataFrame:
    """docs with __size, __key (ascending order of the sample), __tie and __bucket."""
    text = F.col("text").cast("string")
    sized = docs.withColumn("__size", n_words(text))
    high = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), text)), 11)
    uniform = (high + F.lit(0.5)) / F.lit(float(1 << 53))
    key = -F.log(uniform) / quality_weight(text, F.col("__size"))
    with_key = sized.withColumns({"__key": key, "__tie": F.xxhash64(text)})
    return with_key.withColumn("__bucket", F.least(F.lit(BUCKETS - 1), F.floor(BUCKETS * (1 - F.exp(-F.col("__key"))))).cast("int"))


def plan(rows: DataFrame, **how) -> DataFrame:
    """A row for each source s: source_size, target, epochs, and the last stretch, key and tie that the fraction takes."""
    sizes = written(rows.groupBy("source", "__bucket").agg(F.sum("__size").alias("n")), "stretches")
    goal = targets(sizes.groupBy("source").agg(F.sum("n").alias("n")), **how)
    epochs = F.when(F.col("n") > 0, F.least(F.floor(F.col("target") / F.col("n")), F.lit(2**30))).otherwise(0).cast("int")
    goal = goal.select(F.col("source").alias("s"), F.col("n").alias("source_size"), "target", epochs.alias("epochs")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # Written, as are the ends: joins by source then have nothing else by source in their stage.
    goal = written(goal, "goals")
    upto = Window.partitionBy("source").orderBy("__bucket")
    before = sizes.withColumn("before", F.sum("n").over(upto) - F.col("n"))
    last = before.join(goal.select("s", "rest"), F.col("source").eqNullSafe(F.col("s"))).where("before < rest").groupBy("s").agg(F.max(F.struct("__bucket", "before", "rest")).alias("c"))
    last = written(last.select("s", F.col("c.__bucket").alias("last_bucket"), "c.before", "c.rest"), "last")
    order = Window.partitionBy("s").orderBy("__key", "__tie")
    inside = rows.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("__bucket") == F.col("last_bucket")))
    ends = inside.withColumn("middle", F.col("before") + F.sum("__size").over(order) - F.col("__size") / 2).where("middle <= rest").groupBy("s").agg(F.max(F.struct("__key", "__tie")).alias("end"))
    # Where none of the stretch fits, all before it does.
    by_null_safe = lambda left, right, cols: left.join(right.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left").drop("t").select("*", *cols)
    out = by_null_safe(goal, last.select("s", "last_bucket"), [])
    out = by_null_safe(out, ends, [F.col("end.__key").alias("last_key"), F.col("end.__tie").alias("last_tie")]).drop("end", "rest")
    return written(out.withColumn("last_bucket", F.coalesce("last_bucket", F.lit(-1))), "plan")


def with_copies(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """rows with source_size, target and __copies."""
    key, tie = F.col("__key"), F.col("__tie")
    within = (F.col("__bucket") < F.col("last_bucket")) | ((F.col("__bucket") == F.col("last_bucket")) & ((key < F.col("last_key")) | ((key == F.col("last_key")) & (tie <= F.col("last_tie")))))
    joined = rows.join(by_source, F.col("source").eqNullSafe(F.col("s")))
    return joined.withColumn("__copies", F.col("epochs") + F.when(F.coalesce(within, F.lit(False)), 1).otherwise(0))


def shares(docs: DataFrame, **how) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, taken."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = written(keyed(narrow).drop("text"), "mixing")
    out = with_copies(rows, plan(rows, **how))
    return out.select("doc_id", "source", F.col("__size").alias("size"), "source_size", "target", F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).cast("long").alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of docs as often as they are taken, in the columns they came in."""
    needed = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")]
    by_source = plan(written(keyed(docs.select(*needed)).drop("text"), "mixing"), **how)
    taken = with_copies(keyed(packed(docs, *needed)), by_source).where("__copies > 0")
    return unpacked(taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))))
