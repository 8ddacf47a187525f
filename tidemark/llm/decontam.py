"""Benchmark decontamination by template canonicalisation.

Numbers, names and units are replaced by typed placeholders, so a question that was given other
values keeps its template.  Windows of K canonical tokens are hashed; those of the documents are
joined to those of the benchmark, and a document counts as contaminated by an item when it holds
enough of the item's windows and the values in the slots map consistently from item to document,
either in one occurrence of the item (windows of like offset) or over the first place of each window.

A capitalised word that begins a sentence may be a name or not, so windows with one are hashed both
ways.  An item without a window of K tokens with LITERALS literal ones (it is too short, or has too
many values) is one window of its own length: as a template, if that has LITERALS literal tokens, and
word for word, if it has SHORTEST words.

Documents are read once.  A bitmap of fixed size over the benchmark's hashes leaves out almost all
of their windows before the join; what it lets through wrongly, the join drops.  No step groups the
windows of more than one document and item.

Defined results: a null text counts as empty and holds nothing; very long texts are taken whole;
items of fewer than SHORTEST words that are no template are not looked for, as any text may hold them;
items are told apart by item_id and text, and an item without item_id counts but is not named;
rows that are equal in doc_id and text are judged together and listed once, rows without doc_id by
their text; empty tables give an empty result.  Other columns are ignored by ``contaminated`` and
carried along by ``remove_contaminated``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import identity, packed, unpacked, written

K, LITERALS, SHORTEST = 8, 5, 4
#: Offsets of one occurrence differ by no more: values may have more words than those they stand for.
GAP = 3
BITS = 22

# Units that may follow a number.
UNITS = frozenset("mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg kilogram kilograms gram grams lb lbs oz ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur degree degrees mph kmh kg/m w kw kwh v hz khz mhz ghz gb mb kb tb".split())
EDGES = ".,;:!?'\"()[]{}<>*_`“”‘’«»"
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?[%€$£]?")

_U = np.uint64
_M64 = (1 << 64) - 1
LITERAL, IS_NUMBER, IS_UNIT, IS_NAME = 0, 1, 2, 3
PLACEHOLDERS = ("", "<number>", "<unit>", "<name>")
_MARK = np.array([0] + [xxhash.xxh3_64_intdigest(p) for p in PLACEHOLDERS[1:]], np.uint64)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def word_code(word: str) -> int:
    """A word's literal hash with its kind in the two lowest bits and, above, whether it ends a sentence."""
    bare = word.strip(EDGES)
    low = bare.lower()
    if NUMBER.fullmatch(bare):
        kind = IS_NUMBER
    elif low in UNITS:
        kind = IS_UNIT
    elif len(bare) > 1 and bare[0].isupper() and bare[1:].islower():
        kind = IS_NAME
    else:
        kind = LITERAL
    ends = word.rstrip("\"')]”’»")[-1:] in tuple(".!?:")
    return xxhash.xxh3_64_intdigest(low) & ~7 & _M64 | (4 if ends else 0) | kind


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64; a prefix sum then gives the hashes of windows of any length."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            m = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(m - 1, x)))) for x in (_BASE, _BASE_INVERSE))
        return self.up[:n], self.down[:n]


def finished(h: np.ndarray, size: int, exact: bool) -> np.ndarray:
    """Hashes spread over all bits; windows of other lengths or kinds get others."""
    h = (h + _U(2 * size + exact)) * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(31)
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


class Canon:
    """Canonical tokens of whole texts; codes of words are cached, bounded."""

    def __init__(self, most: int = 300_000):
        self.most, self.known, self.powers = most, {}, Powers()

    def codes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = word_code(w)
            return np.array([known[w] for w in words], np.uint64)

    def readings(self, code: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Kinds of tokens, and which of them this reading differs by from the first: names at the head of a sentence are literal, or names."""
        kind = (code & _U(3)).astype(np.int8)
        after_end = np.concatenate(([True], (code[:-1] & _U(4)) > 0))
        after_number = np.concatenate(([False], kind[:-1] == IS_NUMBER))
        kind[(kind == IS_UNIT) & ~after_number] = LITERAL
        heads = (kind == IS_NAME) & after_end
        plain = np.where(heads, LITERAL, kind).astype(np.int8)
        return [(plain, None), (kind, heads)] if heads.any() else [(plain, None)]

    def windows(self, text: str | None, lengths: tuple[int, ...] = (), whole: bool = False) -> tuple[list[str], list[tuple]]:
        """Words, and (size, exact, hashes, which of them count, kinds) of the windows of K tokens and of other lengths.

        whole: the text is an item; where none of its windows of K counts, it is one window itself.
        """
        words = (text or "").split()
        n = len(words)
        if not n or (n < K and not whole and (not lengths or n < min(lengths))):
            return words, []
        code = self.codes(words)
        up, down = self.powers.upto(n)
        plain = code & _U(~7 & _M64)
        sums = lambda x: np.concatenate((np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)))
        of = lambda s, size: s[size:] - s[: n + 1 - size]
        readings = self.readings(code)
        prefix = [(kind, sums(np.where(kind == LITERAL, plain, _MARK[kind]) * up), sums((kind == LITERAL).astype(np.int64)), None if heads is None else sums(heads.astype(np.int64))) for kind, heads in readings]
        out = []

        def add(size: int) -> None:
            for kind, tokens, literals, heads in prefix:
                good = of(literals, size) >= LITERALS
                if heads is not None:
                    good &= of(heads, size) > 0
                out.append((size, False, finished(of(tokens, size) * down[: n + 1 - size], size, False), good, kind))

        def add_exact(size: int) -> None:
            out.append((size, True, finished(of(sums(plain * up), size) * down[: n + 1 - size], size, True), np.full(n + 1 - size, size >= SHORTEST), None))

        if n >= K:
            add(K)
        if whole and not any(x[3].any() for x in out):
            lengths = (n,)
        for size in lengths:
            if size <= n:
                add(size) if size != K else None
                add_exact(size)
        return words, out


def slots(words: list[str], kind: np.ndarray | None, at: int, size: int = K) -> list[str]:
    """The values in a window, or, word for word, all of it."""
    return [words[i].strip(EDGES).lower() for i in range(at, at + size) if kind is None or kind[i] != LITERAL]


WINDOWS = "h1 long, h2 long, id long, gram long, pos int, size int, exact boolean, slots array<string>"


def _windows(rows: DataFrame, keep: bytes | None = None, lengths: tuple[int, ...] = ()) -> DataFrame:
    """A row for each window that counts of (h1, h2, id, text); keep: a bitmap of hashes, else the rows are items."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        bitmap = None if keep is None else np.unpackbits(np.frombuffer(keep, np.uint8)).astype(bool)
        empty: tuple[list, ...] = ([], [], [], [], [], [], [], [])
        for b in batches:
            out = tuple(list(x) for x in empty)
            for h1, h2, i, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                words, found = canon.windows(text, lengths, whole=keep is None)
                for size, exact, h, good, kind in found:
                    if bitmap is not None:
                        good = good & bitmap[(h >> _U(64 - BITS)).astype(np.int64)]
                    for at in np.flatnonzero(good).tolist():
                        for col, v in zip(out, (h1, h2, i, int(h[at].view(np.int64)), at, size, exact, slots(words, kind, at, size))):
                            col.append(v)
                if len(out[0]) > 20_000:
                    yield _batch(out)
                    out = tuple(list(x) for x in empty)
            yield _batch(out)

    return rows.mapInArrow(each, WINDOWS)


def _batch(out: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=[x.split()[0] for x in WINDOWS.split(", ")])


def bitmap(benchmark_windows: DataFrame) -> bytes:
    """2**BITS bits, whatever the size of the benchmark: which leading bits of a hash occur in it."""
    bit = F.shiftrightunsigned("gram", 64 - BITS).cast("int")
    bits = np.zeros(1 << BITS, bool)
    for r in benchmark_windows.select(bit.alias("b")).distinct().toLocalIterator():
        bits[r.b] = True
    return np.packbits(bits).tobytes()


def _identified(rows: DataFrame, id: str) -> DataFrame:
    i, text = F.col(id).cast("long"), F.col("text").cast("string")
    return rows.select(*identity(i, text), i.alias("id"), text.alias("text"))


def matches(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.5, consistent: float = 0.75) -> DataFrame:
    """h1, h2 (identity of doc_id and text), doc_id, item_id, coverage, n_slots, n_consistent of each contaminated document and item.

    least: share of an item's windows that a document must hold.  consistent: share of an item's slot
    values that must stand for one value throughout the occurrence.
    """
    item, doc = ["i1", "i2"], ["h1", "h2"]
    ours = written(_windows(_identified(benchmark, "item_id")).withColumnsRenamed({"h1": "i1", "h2": "i2", "id": "item_id", "pos": "item_pos", "slots": "item_slots"}).distinct(), "items")
    total = ours.groupBy(*item).agg(F.countDistinct("item_pos").alias("n_windows"))
    # As many as there are items of different lengths without a window of K.
    lengths = tuple(sorted(r.size for r in ours.where(f"size <> {K} or exact").select("size").distinct().collect()))
    theirs = _windows(_identified(docs, "doc_id"), bitmap(ours), lengths).withColumnRenamed("id", "doc_id").drop("size", "exact")
    # Few windows remain; they are written so that the questions below don't read the documents again.
    hits = written(theirs, "windows").join(ours, "gram").where("not exact or slots = item_slots").distinct()
    place = F.col("pos") - F.col("item_pos")
    by_place = Window.partitionBy(*doc, *item).orderBy("place")
    placed = hits.withColumn("place", place).withColumn("new", (place - F.lag("place").over(by_place) > GAP).cast("int"))
    placed = written(placed.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(by_place)).select(*doc, "doc_id", *item, "item_id", "item_pos", "pos", "slots", "item_slots", "run"), "hits")
    # One row for each window of an item in an occurrence, and for its first place in the document.
    runs = placed.unionByName(placed.withColumn("run", F.lit(-1).cast("long")))
    one = [*doc, *item, "run"]
    held = runs.groupBy(*one, "doc_id", "item_id", "item_pos").agg(F.min(F.struct("pos", "slots", "item_slots")).alias("h")).select(*one, "doc_id", "item_id", "h.slots", "h.item_slots")
    values = held.select(*one, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).groupBy(*one, F.col("s.item_slots").alias("value")).agg((F.min("s.slots") == F.max("s.slots")).alias("same"))
    agree = values.groupBy(*one).agg(F.count("*").alias("n_slots"), F.sum(F.col("same").cast("long")).alias("n_consistent"))
    cover = held.groupBy(*one, "doc_id", "item_id").agg(F.count("*").alias("n")).join(total, item).withColumn("coverage", F.col("n") / F.col("n_windows")).where(F.col("coverage") >= least)
    zero = F.lit(0).cast("long")
    out = cover.join(agree, one, "left").withColumns({"n_slots": F.coalesce("n_slots", zero), "n_consistent": F.coalesce("n_consistent", zero)}).where(F.col("n_consistent") >= consistent * F.col("n_slots"))
    best = F.max(F.struct("coverage", "n_consistent", "n_slots")).alias("b")
    return out.groupBy(*doc, *item, "doc_id", "item_id").agg(best).select(*doc, "doc_id", "item_id", "b.coverage", "b.n_slots", "b.n_consistent")


def contaminated(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """A row for each contaminated document: doc_id, item_ids (sorted), coverage (the largest)."""
    found = matches(docs, benchmark, **limits)
    return found.groupBy("h1", "h2", "doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage")).drop("h1", "h2")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The rows of docs that hold no item, in the columns they came in."""
    # Written, so that nothing else by h1 and h2 shares the stage of the join.
    bad = written(matches(docs, benchmark, **limits).select("h1", "h2").distinct(), "contaminated")
    return unpacked(packed(docs, *identity(F.col("doc_id").cast("long"), F.col("text").cast("string"))).join(bad, ["h1", "h2"], "left_anti"))
