"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

1.  Every whole text becomes its set of hashed word shingles.  Texts of equal sets form a class,
    which goes on as its smallest doc_id, so copies are never paired.
2.  SuperMinHash: an element visits the M slots of the signature in the order of its own
    permutation, and its value in step j lies in [j, j + 1).  Slots that a step fills are final, so
    the steps run over all elements of a batch at once and a text is done, early for all but short
    ones, when its slots are full.
3.  BANDS bands of ROWS slots are hashed; classes that share a band's hash share a bucket.
4.  In each bucket the classes are compared with a hub: the one with most fellows over all its
    buckets, which is nearest the middle of a cloud of copies.  Those not linked are compared with a
    second hub.  What then still shares a bucket without being in one component is compared pair by
    pair within blocks of bounded size, so no link within a bucket is lost however large it is.
    Comparison always is on the full sets.
5.  Links are merged by local union-find and alternating large and small stars until nothing moves.

With 24 bands of 4, a pair of similarity 0.8 shares no band with a probability of 3 in a million.

A class is a node, and nodes are numbered in the order of their smallest doc_id, so the smallest node
of a component has its smallest doc_id.

Defined results: a null or wordless text has an empty set and is linked with nothing; very long texts
are taken whole; a row without doc_id is linked by its text, has its component's smallest doc_id or, if
none has one, no component, and is kept only in such a component's first class; rows that share doc_id
and text share the result; rows that share a doc_id but not the text are judged by their own text each;
an empty table gives an empty result.  Other columns are ignored by ``group`` and carried along by
``keep_one``, whatever their names; ``keep_one`` leaves one of rows that are equal in doc_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import first_of, identity, packed, unpacked, written

BANDS, ROWS = 24, 4
M = BANDS * ROWS
#: Most members of a block, and about the most shingles that they have together.
BLOCK, BLOCK_ITEMS = 256, 2_000_000

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_ODD = [_U(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingles:
    """Sorted distinct 64-bit hashes of the k-word shingles of whole texts; word hashes are cached, bounded."""

    def __init__(self, k: int, most: int = 300_000):
        self.k, self.most, self.known = k, most, {}

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() is A-Z alone
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([known[w] for w in words], np.uint64)
        k = min(self.k, len(h))
        n = len(h) - k + 1
        out = np.full(n, _U(k * int(_GOLD) % 2**64))
        for j in range(k):
            out += mixed(h[j : j + n] + _ODD[j % 5]) * _ODD[j % 5]
        return np.unique(mixed(out))


def superminhash(elements: np.ndarray, owner: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """Signatures (n, m) of n sets: elements has their hashes, owner whose they are (0 to n - 1)."""
    full = np.iinfo(np.uint64).max
    sig = np.full(n * m, full, np.uint64)
    perm = None
    for j in range(m):
        if not len(elements):
            break
        h = mixed(elements + _U(int(_GOLD) * (j + 1) % 2**64))
        k = (j + (((h & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32))).astype(np.int64)
        if j == 0:
            slot, first = k, k
        else:
            rows = np.arange(len(elements))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = slot
        at = owner * m + slot
        free = sig[at] == full
        np.minimum.at(sig, at[free], (h[free] >> _U(24)) | (_U(j) << _U(40)))
        open_ = (sig.reshape(n, m) == full).any(axis=1)[owner]
        if not open_.all():
            elements, owner = elements[open_], owner[open_]
            perm = perm[open_] if perm is not None else None
            first = first[open_] if j == 0 else None
        if j == 0:
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(elements), 1))
            rows = np.arange(len(elements))
            perm[rows, first] = 0
            perm[:, 0] = first
    return sig.reshape(n, m)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    x = sig.reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, (len(sig), BANDS)).copy()
    for r in range(ROWS):
        out = mixed(out + x[:, :, r] * _ODD[r])
    return out.view(np.int64)


KEY = ["key_a", "key_b", "n_shingles"]


def _columns() -> tuple:
    return F.col("doc_id").cast("long"), F.col("text").cast("string")


def features(docs: DataFrame, k: int) -> DataFrame:
    """h1 and h2 (identity of doc_id and text), doc_id, n_shingles, class hashes key_a and key_b, bands."""
    doc_id, text = _columns()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)

        def out(head: list[pa.Array], sets: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(sets)), sizes)
            bands = band_hashes(superminhash(flat, owner, len(sets)))
            some = np.where(sizes > 0, BANDS, 0)
            offsets = np.concatenate(([0], np.cumsum(some))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[sizes > 0].ravel()))
            with np.errstate(over="ignore"):
                a = [int(mixed(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                b = [int(np.bitwise_xor.reduce(mixed(s ^ _GOLD)).view(np.int64)) if len(s) else 0 for s in sets]
            return pa.RecordBatch.from_arrays([*head, pa.array(sizes), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists], names=["h1", "h2", "doc_id", "n_shingles", "key_a", "key_b", "bands"])

        for batch in batches:
            lo, sets, size = 0, [], 0
            for i, text in enumerate(batch.column(3).to_pylist()):
                sets.append(shingles.of(text))
                size += len(sets[-1])
                if size > 200_000 or i == batch.num_rows - 1:
                    yield out([batch.column(c).slice(lo, len(sets)) for c in range(3)], sets)
                    lo, sets, size = i + 1, [], 0

    narrow = docs.select(*identity(doc_id, text), doc_id.alias("doc_id"), text.alias("text"))
    return narrow.mapInArrow(each, "h1 long, h2 long, doc_id long, n_shingles long, key_a long, key_b long, bands array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, k: int, at_once: int = 1_000_000) -> DataFrame:
    """node, items (the full sets) of the rows whose h1 and h2 are in nodes (h1, h2, node)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for b in batches:
            lo, sets, size = 0, [], 0
            for i, text in enumerate(b.column(1).to_pylist()):
                sets.append(shingles.of(text).view(np.int64))
                size += len(sets[-1])
                if size > at_once or i == b.num_rows - 1:
                    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(sets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["node", "items"])
                    lo, sets, size = i + 1, [], 0

    doc_id, text = _columns()
    once = first_of(docs.select(*identity(doc_id, text), text.alias("text")), ["h1", "h2"])
    return once.join(nodes, ["h1", "h2"]).select("node", "text").mapInArrow(each, "node long, items array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    a, b = sets.select(F.col("node").alias("u"), F.col("items").alias("x")), sets.select(F.col("node").alias("v"), F.col("items").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    n = F.size("x") + F.size("y")
    fits = (100 * F.least(F.size("x"), F.size("y")) >= percent * F.greatest(F.size("x"), F.size("y")))
    return pairs.join(a, "u").join(b, "v").where(fits & (100 * common >= percent * (n - common))).select("u", "v")


def local_forests(edges: DataFrame, at_once: int = 400_000) -> DataFrame:
    """Union-find over stretches of each partition's edges: (u, v) with v the root of u, an equivalent set of edges."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.get(top, top)) != top:
                top = up
            while (up := root.get(x, x)) != top:
                root[x], x = top, up
            return top

        def out() -> pa.RecordBatch:
            us = [x for x in root if find(x) != x]
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array([find(x) for x in us], pa.int64())], names=["u", "v"])

        n = 0
        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a, c = find(u), find(v)
                root[max(a, c)] = root[min(a, c)] = min(a, c)
                n += 1
                if n >= at_once:
                    yield out()
                    root.clear()
                    n = 0
        if root:
            yield out()

    return edges.select("u", "v").mapInArrow(each, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes on an edge but the smallest ones.

    Alternates large stars (link greater neighbours to the smallest) and small stars (the others),
    with each round written to the shared folder.  Minima are taken by aggregation, so a node with
    many edges is no large group anywhere.
    """
    seen = None
    now = written(local_forests(edges).distinct(), "links")
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join has nothing else by u in its stage and Spark can split a node with many neighbours.
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "links")


def _labelled(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """members with comp, the component of node so far."""
    if links is None:
        return members.withColumn("comp", F.col("node"))
    comps = components(links)
    return members.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def _unsettled(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component, with n members and ``items`` shingles of the bucket.

    The sizes are written first, so that the join by bucket has nothing else by bucket in its stage and
    Spark can split a large bucket.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("items"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket", "n", "items")
    return members.drop("n", "items").join(written(sizes, "sizes"), "bucket")


def _with_hub(members: DataFrame, second: bool = False) -> DataFrame:
    """(u, v): each member and its bucket's hub where they are in different components.

    second: the hub is the best of the second best component.
    """
    rank = F.struct(F.col("weight"), (-F.col("node")).alias("less"), "node", "comp")
    if second:
        # The best of each component, of which a task hands on two: a bucket of any size is few rows in the shuffle.
        each = members.groupBy("bucket", "comp").agg(F.max(rank).alias("hub"))
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("hub")))
        hubs = each.withColumn("place", place).where("place <= 2").where("place = 2").select("bucket", "hub")
    else:
        hubs = members.groupBy("bucket").agg(F.max(rank).alias("hub"))
    # Written for the same reason as sizes.
    return members.join(written(hubs, "hubs"), "bucket").where(F.col("comp") != F.col("hub.comp")).select(F.col("node").alias("u"), F.col("hub.node").alias("v")).distinct()


def _in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components within buckets, by comparing all pairs in blocks of bounded numbers of members and of shingles."""
    n_blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("items") / BLOCK_ITEMS)).cast("int")
    mine = members.select("bucket", "node", "comp", n_blocks.alias("n_blocks"), F.pmod(F.xxhash64("node", "bucket"), n_blocks).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    dealt = mine.select("bucket", "node", "comp", "block", other.alias("other")).select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "comp")

    def each(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node")
        comp, size = group.comp.to_numpy(), group["items"].map(len).to_numpy()
        if len(np.unique(comp)) < 2:
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        flat, who = np.concatenate(group["items"].to_list()), np.repeat(np.arange(len(group)), size)
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], who[order]
        item = np.concatenate(([0], np.cumsum(flat[1:] != flat[:-1])))
        common, width = np.zeros((len(group), len(group)), np.float32), 4096
        for lo in range(0, int(item[-1]) + 1, width):
            a, b = np.searchsorted(item, (lo, lo + width))
            has = np.zeros((len(group), width), np.float32)
            has[who[a:b], item[a:b] - lo] = 1
            common += has @ has.T
        similar = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        u, v = np.nonzero(np.triu(similar & (comp[:, None] != comp[None, :])))
        node = group.node.to_numpy()
        return pd.DataFrame({"u": node[u], "v": node[v]})

    return dealt.join(sets, "node").groupBy("bucket", "i", "j").applyInPandas(each, "u long, v long")


def _grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """features(); classes (KEY, doc_id, h1, h2 of their first row, node); components (node, component)."""
    feats = written(features(docs, k), "shingles")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")).alias("first")
    by = feats.where("n_shingles > 0").groupBy(*KEY).agg(first, F.first("bands").alias("bands"))
    # Numbers rise with the sort, whose ranges Spark deals to partitions in order.
    classes = written(by.orderBy("first").select(*KEY, "first.doc_id", "first.h1", "first.h2", "bands", F.monotonically_increasing_id().alias("node")), "classes")
    postings = classes.select(F.explode("bands").alias("bucket"), "node", "n_shingles")
    shared = postings.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("who")).where("n > 1")
    # Buckets of the same members say the same; one of them stays, with the weight of all.
    buckets = shared.groupBy("n", "who").agg(F.min("bucket").alias("bucket"), F.count("*").alias("times"))
    members = written(postings.join(buckets, "bucket").select("bucket", "node", "n_shingles", "n", "times").distinct(), "buckets")
    weights = members.groupBy("node").agg(F.sum(F.col("n") * F.col("times")).alias("weight"))
    members = members.select("bucket", "node", "n_shingles").join(weights, "node")
    nodes = classes.select("h1", "h2", "node").join(members.select("node").distinct(), "node", "left_semi")
    sets = written(shingle_sets(docs, nodes, k), "sets")

    members = _labelled(members, None)
    links = written(verified(_with_hub(members), sets, percent), "links")
    members = written(_unsettled(_labelled(members.drop("comp"), links)), "unsettled")
    again = written(verified(_with_hub(members, second=True), sets, percent), "links")
    links = links.unionByName(again)
    # A bucket of two has had its only pair compared.
    many = written(_unsettled(_labelled(members.drop("comp"), links)).where("n > 2"), "unsettled")
    links = written(links.unionByName(_in_blocks(many, sets, percent)), "links")
    return feats, classes.drop("bands"), components(links)


def group(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept.

    Texts are linked whose sets of k-word shingles have a similarity of percent or more.
    """
    feats, classes, comps = _grouped(docs, k, percent)
    roots = classes.select(F.col("node").alias("component"), F.col("doc_id").alias("root_id"))
    linked = comps.join(roots, "component").select("node", "root_id", F.lit(False).alias("is_root"))
    by_class = classes.join(linked, "node", "left").select(*KEY, F.coalesce("is_root", F.lit(True)).alias("is_root"), F.when(F.col("is_root").isNull(), F.col("doc_id")).otherwise(F.col("root_id")).alias("group_id"))
    out = feats.select("doc_id", *KEY).join(by_class, KEY, "left")
    own = F.col("n_shingles") == 0
    component = F.when(own, F.col("doc_id")).otherwise(F.col("group_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "is_root")
    kept = F.when(F.col("component_id").isNull(), own | F.col("is_root")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.withColumn("kept", kept).drop("is_root")


def keep_one(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, in the columns docs came in: that of the smallest doc_id.

    Of rows of one group that share it, the one with the smallest hash of its text stays.  Texts without
    words are groups of their own.
    """
    feats, classes, comps = _grouped(docs, k, percent)
    roots = classes.join(comps.select("node"), "node", "left_anti").select("h1", "h2")
    # Written, so that nothing else by h1 and h2 shares the stage of the join.
    stay = written(roots.unionByName(feats.where("n_shingles = 0").select("h1", "h2").distinct()), "stay")
    return unpacked(first_of(packed(docs, *identity(*_columns())), ["h1", "h2"]).join(stay, ["h1", "h2"], "left_semi"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The result of group(k=4, percent=80) by comparing all pairs of texts that share a shingle.
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.d),
c AS (SELECT d, min(m) AS component_id FROM r GROUP BY d)
SELECT d AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.d
"""
