from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.helpers import brute_one_of_each, contaminated_by_hand, empty_docs, kept_by_hand, odd_docs, shingle_set, targets_by_hand
from tidemark.llm.common import written


def harder(spark, sf):
    """documents, with rows that share a doc_id or have none, repeated rows, nulls, and columns whose names clash."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    good = [r for r in rows if len((r.text or "").split()) > 120][:6]
    more = [(None, good[0].text, good[0].lang, "src1", 1), (good[1].doc_id, good[2].text, good[2].lang, "src2", 1), tuple(good[3]), tuple(good[3]), (10**6, good[4].text + " and a few words more", good[4].lang, None, 1)]
    more += [(10**6 + 1, None, None, None, None), (None, "", "en", "src1", 0), (None, good[5].text, None, "src3", 1)]
    return docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumns({"h1": F.lit(1), "row": F.lit("r"), "a.b": F.lit(2), "__key": F.lit(3), "kept": F.lit(4)})


def test_stages_against_brute_force(spark, sf):
    docs = written(harder(spark, sf), "harder")
    columns, bench = docs.columns, spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    whole = lambda df: Counter(tuple(r) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)

    rows = docs.collect()
    after = written(stages["quality_rules"](spark, docs, sf), "one")
    assert after.columns == columns
    assert whole(after) == Counter(tuple(r) for r, (*_, kept) in zip(rows, kept_by_hand([(r.text, r.lang) for r in rows])) if kept)

    rows, docs = after.collect(), after
    after = written(stages["near_duplicates"](spark, docs, sf), "two")
    assert after.columns == columns and not whole(after) - whole(docs)
    got = [(r.doc_id is None, r.doc_id or 0, r.text) for r in after.collect()]
    assert sorted((x if not shingle_set(x[2], 5) else x[:2] for x in got), key=str) == brute_one_of_each([(r.doc_id, r.text) for r in rows], 80, 5)

    rows, docs = after.collect(), after
    after = written(stages["decontamination"](spark, docs, sf), "three")
    bad = {d for d, _ in contaminated_by_hand([r.text for r in rows], [b.text for b in bench])}
    assert after.columns == columns and whole(after) == Counter(tuple(r) for i, r in enumerate(rows) if i not in bad) and bad

    rows, docs = after.collect(), after
    after = written(stages["mixing_sources"](spark, docs, sf), "four")
    assert after.columns == columns
    taken, size, words, largest = whole(after), Counter(), Counter(), Counter()
    for r in rows:
        n = len(r.text.split())
        size[r.source] += n
        words[r.source] += n * taken[tuple(r)]
        largest[r.source] = max(largest[r.source], n)
    copies = defaultdict(set)
    for r in rows:
        copies[r.source].add(taken[tuple(r)])
    goal = targets_by_hand(dict(size))
    for s, target in goal.items():
        whole_epochs = int(target // size[s])
        assert copies[s] <= {whole_epochs, whole_epochs + 1} and abs(words[s] - target) <= largest[s] / 2 + 1

    out = stages["sharding"](spark, after, sf).collect()
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in out) == Counter((r.doc_id, zlib.crc32(r.text.encode()), len(r.text.encode()) + 1) for r in after.collect())
    by, total = defaultdict(list), Counter()
    for r in out:
        by[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(8))
    mean = sum(total.values()) / 8
    assert all(abs(t - mean) < 0.05 * mean for t in total.values())


def test_run_and_odd_tables(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    for docs in (odd_docs(spark), empty_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, docs, sf), name)
            if name != "sharding":
                assert out.columns == docs.columns
