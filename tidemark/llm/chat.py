"""Chat formatting: snapshots of a conversation that a longer log continues collapse into it.

A logged conversation is a list of turns.  Rolling hashes of its prefixes (two of 64 bits, each the
exclusive or of hashes of position, role and text) say in one join whether all its turns begin a
longer conversation; anti-joins keep the maximal ones, and of equal conversations the one with the
smallest conv_id.  Only hashes are shuffled until that is known; then the turns of the kept
conversations are gathered and rendered.

Defined results: turns are ordered by turn (null first), then role and hash; rows without conv_id
belong to no conversation and are left out; a null role is rendered as ``unknown`` and a null text
as empty, and both differ from any other value; repeated rows are repeated turns; an empty table
gives an empty result; other columns are ignored, whatever their names; very long texts are taken whole.
A rendered conversation is one value, so one conversation must fit into a task's memory; nothing else must.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The rendered form of a turn.
OPEN, BETWEEN, CLOSE = "<|", "|>\n", "<|end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    c = conversations.select(*(F.col(k).cast(t).alias(k) for k, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    return c.where(F.col("conv_id").isNotNull())


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, n_turns and the two hashes of turns 1 to pos."""
    parts = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    narrow = _turns(conversations).select("conv_id", "turn", "role", F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "a", "b")
    rolling = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = narrow.withColumn("pos", F.row_number().over(order))
    rolled = [F.bit_xor(F.xxhash64("pos", k)).over(rolling).alias(f"hash_{k}") for k in "ab"]
    return placed.select("conv_id", "pos", *rolled).withColumn("n_turns", F.max("pos").over(Window.partitionBy("conv_id")))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id of the conversations that begin no longer one, one of equal ones."""
    p = prefixes(conversations)
    key = ["pos", "hash_a", "hash_b"]
    ends = p.where("pos = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    begun = p.where("pos < n_turns").select(*key).distinct()
    return ends.join(begun, key, "left_anti").select("conv_id")


def render(conversations: DataFrame) -> DataFrame:
    """The maximal conversations as text: conv_id, n_turns, n_chars, rendered."""
    turns = _turns(conversations).join(maximal(conversations), "conv_id", "left_semi")
    shown = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit(BETWEEN), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    tie = F.xxhash64(F.lit(1), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.col("role"), tie.alias("tie"), shown.alias("shown")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    out = whole.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.col("ts.shown"), "").alias("rendered"))
    return out.select("conv_id", "n_turns", F.length("rendered").cast("long").alias("n_chars"), "rendered")


ORACLE = """
WITH t AS (
    SELECT conv_id, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS shown,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST) AS pos,
           count(*) OVER (PARTITION BY conv_id) AS n_turns
    FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, pos, n_turns, string_agg(shown, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t),
f AS (SELECT min(conv_id) AS conv_id, pos AS n_turns, prefix AS rendered FROM p WHERE pos = n_turns GROUP BY pos, prefix)
SELECT conv_id, n_turns, length(rendered) AS n_chars, rendered FROM f
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n_turns AND p.pos = f.n_turns AND p.prefix = f.rendered)
"""
