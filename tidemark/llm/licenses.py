"""License scan by diagonal voting.

All rolling hashes of K words of every text are joined to the positions of the same hashes in a
registry of license templates.  A hit at word p of the text and word t of the template votes for the
diagonal p - t; votes of a diagonal add up, diagonals that lie within GAP of each other are merged
(words put in or left out shift the rest of a notice), and a merged span counts when it covers
enough of its template within a span of about the template's length.

Everything runs as DataFrame expressions.  The registry is a constant of this module (its grams are
bounded), so it is broadcast.  Votes are grouped per text and template; no group exceeds a text.

Defined results: a null text counts as empty; very long texts are scanned whole, each gram a row;
texts are told apart by 128 bits of doc_id and text, so rows that share a doc_id are scanned each for
itself, and rows without one keep none; repeated rows each get a row; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import identity, written

K = 4
GAP = 3
KEY = ["h1", "h2"]

# Phrases of the base rule and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices as their licenses give them, and their labels.
TEMPLATES = [
    ("mit", "released under the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def words(text: Column) -> Column:
    """The words of a text.  lower() also lowers letters beyond ASCII; that moves no edge of a word
    and makes no ASCII word but by the Kelvin sign, whose k occurs in no phrase of the base rule."""
    found = F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    n = F.size(found)
    first = F.when(F.element_at(found, 1) == "", 2).otherwise(1)
    last = F.when((n > 1) & (F.element_at(found, -1) == ""), n - 1).otherwise(n)
    return F.slice(found, first, F.greatest(last - first + 1, F.lit(0)))


def registry(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """gram, template, at, n_grams, label: a row for each K words of each template."""
    rows = []
    for i, (label, text) in enumerate(templates):
        ws = template_words(text)
        rows += [(i, at, len(ws) - K + 1, label, *ws[at : at + K]) for at in range(len(ws) - K + 1)]
    names = [f"w{j}" for j in range(K)]
    df = spark.createDataFrame(rows, "template int, at int, n_grams int, label string, " + ", ".join(f"{n} string" for n in names))
    return df.select(F.xxhash64(*names).alias("gram"), "template", "at", "n_grams", "label")


def _keyed(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.select("doc_id", *identity(F.col("doc_id"), F.col("text")), words(F.col("text")).alias("words"))


def _places(ws: Column, phrase: str) -> Column:
    """Word positions at which a phrase stands; looked for only where its rarest word occurs."""
    parts = phrase.split()
    rare = {"mit": "mit", "apache-2": "apache", "cc-by-nc": "nc"}[BASE[phrase]]

    def here(i: Column) -> Column:
        same = F.lit(True)
        for j, w in enumerate(parts):
            same = same & (F.get(ws, i + j) == w)
        return same

    none = F.array().cast("array<int>")
    at = F.filter(F.sequence(F.lit(0), F.size(ws) - len(parts)), here)
    return F.when((F.size(ws) >= len(parts)) & F.array_contains(ws, rare), at).otherwise(none)


def base(docs: DataFrame) -> DataFrame:
    ws = F.col("words")
    found = _keyed(docs).select("doc_id", *KEY, F.size(ws).cast("long").alias("n_words"), *(_places(ws, p).alias(lab) for p, lab in BASE.items()))
    places = F.concat(*(F.col(f"`{lab}`") for lab in BASE.values()))
    labels = F.array_compact(F.array(*(F.when(F.size(F.col(f"`{lab}`")) > 0, F.lit(lab)) for lab in sorted(BASE.values()))))
    return found.select("doc_id", *KEY, "n_words", places.alias("places"), labels.alias("base"))


def votes(docs: DataFrame) -> DataFrame:
    """KEY, template, diagonal: how many grams of the template lie on it, and where."""
    ws = F.col("words")
    n = F.greatest(F.size(ws) - K + 1, F.lit(0))
    # The words of a gram side by side, one slice for each: rows are made and hashed in generated code, and the text is split once.
    side_by_side = F.arrays_zip(*(F.slice(ws, j + 1, n).alias(f"w{j}") for j in range(K)))
    rolled = _keyed(docs).select(*KEY, F.posexplode(side_by_side).alias("pos", "g")).select(*KEY, "pos", F.xxhash64(*(f"g.w{j}" for j in range(K))).alias("gram"))
    hits = rolled.join(F.broadcast(registry(docs.sparkSession)), "gram").select(*KEY, "template", "n_grams", "label", "pos", "at").distinct()
    return hits.groupBy(*KEY, "template", "n_grams", "label", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def spans(docs: DataFrame, *, least: float = 0.6, longest: float = 1.5) -> DataFrame:
    """Verified spans: KEY, label, first, last (gram positions in the text), coverage.

    least: share of the template's grams that must be found; longest: length of the span in templates.
    """
    order = Window.partitionBy(*KEY, "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > GAP
    marked = votes(docs).withColumn("run", F.sum(F.when(far, 1).otherwise(0)).over(order))
    merged = marked.groupBy(*KEY, "template", "n_grams", "label", "run").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    coverage = F.least(F.lit(1.0), F.col("votes") / F.col("n_grams"))
    short = F.col("last") - F.col("first") + 1 <= F.greatest(F.col("n_grams") * longest, F.col("n_grams") + K)
    return merged.withColumn("coverage", coverage).where((F.col("coverage") >= least) & short).select(*KEY, "label", "first", "last", "coverage")


def best(found: DataFrame) -> DataFrame:
    """A row for each text: spans without those that overlap a span of higher coverage.

    Versions of a license share most of their notice; the better match tells which it is.
    """
    lists = found.groupBy(*KEY).agg(F.collect_list(F.struct("first", "last", "coverage", "label")).alias("s"))
    clear = F.filter("s", lambda x: ~F.exists("s", lambda y: (y["coverage"] > x["coverage"]) & (y["first"] <= x["last"]) & (x["first"] <= y["last"])))
    return lists.select(*KEY, clear.alias("s")).select(*KEY, F.array_distinct(F.col("s.label")).alias("more"), F.array_max(F.col("s.coverage")).alias("coverage"), F.size("s").alias("n_spans"))


def scan(docs: DataFrame, **limits) -> DataFrame:
    """A row for each document: n_words, base places and labels, all labels, score, spans."""
    b = base(docs)
    # Written, so that nothing else by KEY shares the stage of the join and Spark can split a row of many copies.
    out = b.join(written(best(spans(docs, **limits)), "notices"), KEY, "left")
    empty = F.array().cast("array<string>")
    both = F.array_sort(F.array_union("base", F.coalesce("more", empty)))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
    )


def oracle(templates=TEMPLATES, least: float = 0.6, longest: float = 1.5) -> str:
    """The result of scan() in SQL, with words in place of hashes."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(lab)}, {quoted(' '.join(template_words(t)))})" for i, (lab, t) in enumerate(templates))
    base_rows = ", ".join(f"({quoted(p)}, {quoted(lab)})" for p, lab in BASE.items())
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    gram = " || ' ' || ".join(f"ws[i + {j}]" if j else "ws[i]" for j in range(K))
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
    bp AS (SELECT phrase, label, string_split(phrase, ' ') AS ps FROM (VALUES {base_rows}) v(phrase, label)),
    bw AS (SELECT doc_id, ws, unnest(range(len(ws))) AS p0 FROM d WHERE list_contains(ws, 'mit') OR list_contains(ws, 'apache') OR list_contains(ws, 'nc')),
    bh AS (SELECT doc_id, p0, label FROM bw JOIN bp ON ws[p0 + 1 : p0 + len(ps)] = ps),
    b AS (SELECT doc_id, count(*) AS n_base, min(p0) AS first_word, max(p0) AS last_word, list(DISTINCT label) AS labs FROM bh GROUP BY doc_id),
    t AS (SELECT id, label, string_split(body, ' ') AS ws FROM (VALUES {rows}) v(id, label, body)),
    tg AS (SELECT id, label, n, i - 1 AS tpos, {gram} AS g FROM (SELECT id, label, ws, len(ws) - {K - 1} AS n, unnest(range(1, len(ws) - {K - 2})) AS i FROM t)),
    dg AS (SELECT doc_id, i - 1 AS pos, {gram} AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {K - 2})) AS i FROM d)),
    v AS (SELECT doc_id, id, label, n, pos - tpos AS diag, count(*) AS votes, min(pos) AS lo, max(pos) AS hi FROM dg JOIN tg USING (g) GROUP BY doc_id, id, label, n, pos - tpos),
    m AS (SELECT *, sum(CASE WHEN gap > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, id ORDER BY diag) AS run FROM (SELECT *, diag - lag(diag) OVER (PARTITION BY doc_id, id ORDER BY diag) AS gap FROM v)),
    q AS (SELECT doc_id, id, label, n, run, least(1.0, sum(votes) / n) AS cov, min(lo) AS lo, max(hi) AS hi FROM m GROUP BY doc_id, id, label, n, run),
    s AS (SELECT *, row_number() OVER () AS rid FROM q WHERE cov >= {least} AND hi - lo + 1 <= greatest(n * {longest}, n + {K})),
    k AS (SELECT * FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.doc_id = x.doc_id AND y.cov > x.cov AND y.lo <= x.hi AND x.lo <= y.hi)),
    a AS (SELECT doc_id, list(DISTINCT label) AS labs, max(cov) AS cov, count(*) AS n_spans FROM k GROUP BY doc_id)
    SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.labs), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labs, []), coalesce(a.labs, [])))), ','), '') AS labels, coalesce(n_spans, 0) AS n_spans,
           CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(cov, 0.0) END AS score
    FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""
