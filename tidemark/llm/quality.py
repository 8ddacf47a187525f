"""Quality rules: distribution divergence from a reference of the document's language.

One pass over the texts counts, for each document, its character classes, the
common words of four languages and the figures of the base rules.  The
references are the mean histograms of all documents of a language that pass the
base rules (kept as integer parts per million, so that sums do not depend on the
order of addition).  A document is rejected when the Jensen-Shannon distance of
its histogram from the reference exceeds a limit, unless it is too short for the
histogram to mean anything (``min_words``, ``min_common``).  The distance of a
short text's common words from their reference is mostly chance; the limit for
them has a term for it that falls with the number of words.

Defined results: a null text counts as empty and fails the base rules, as does an
empty one; a text of any length is measured whole, one at a time; a null language
is a language of its own; a null doc_id is carried along and its row judged like
any other; repeated rows each get a row and the same verdict; an empty table gives
an empty result.  Other columns are ignored by ``score`` and carried along by
``keep_good``, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, identity, packed, unpacked, written

# Frequent function words.
COMMON = {
    "en": "the of and to in is that it for on with as was be by this are from or an at have not but which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur avec ce il sont ne",
    "es": "de la que el en y los se del las un por con no una su para es al lo como más o pero sus",
}
#: Bins of the word histogram: each common word once; the last bin has all other words.
WORDS = sorted({w for ws in COMMON.values() for w in ws.split()})
CLASSES = ("lower_or_digit", "upper", "quote", "space", "stop", "symbol", "other", "beyond_ascii")
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Expected Jensen-Shannon divergence in bits, times the number of words, of a sample from its own reference:
#: a language has some 24 bins with any weight, and the divergence is chi-square by 8 n ln 2.
CHANCE = 4.328

SCHEMA = (
    "h1 long, h2 long, doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, class_ppm array<int>, word_ppm array<int>"
)


def _class_table() -> np.ndarray:
    t = np.full(256, 6, np.uint8)
    for chars, k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 0), (b"'\"", 2), (SPACE.encode(), 3), (b".,;:!?()-", 4), (SYMBOLS.encode(), 5)):
        t[list(chars)] = k
    t[0x80:0xC0] = 8  # the rest of a character that began before
    t[0xC0:] = 7
    return t


TABLE = _class_table()
BINS = {w.encode(): i for i, w in enumerate(WORDS)}
PUNCT = b".,;:!?'\"()-#*$%&|<>"


def repeated_words(words: list) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    hit = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
    cover = np.zeros(len(words), bool)
    for k in range(3):
        cover[k : k + len(windows)] |= hit
    return int(cover.sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def measure(text: str | None, bins: dict[bytes, int] = BINS) -> tuple:
    """Base figures and both histograms of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    classes = np.bincount(TABLE[np.frombuffer(raw, np.uint8)], minlength=9)[:8]
    n_bins = max(bins.values(), default=-1) + 2
    hist = np.zeros(n_bins, np.int64)
    common = 0
    for w, n in Counter(words).items():
        i = bins.get(w)
        if i is None:
            i = bins.get(w.lower().strip(PUNCT), -1)
        if i >= 0:
            hist[i] += n
            common += n
    hist[-1] = len(words) - common
    return (len(words), len(text) - int(classes[3]), int(classes[5]), duplicate_lines(text), repeated_words(words), classes, hist)


def _lists(hists: list[np.ndarray], width: int) -> pa.Array:
    """Histograms in parts per million, rounded down."""
    x = np.array(hists, np.int64).reshape(-1, width)
    ppm = x * 1_000_000 // np.maximum(x.sum(axis=1, keepdims=True), 1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(ppm.ravel().astype(np.int32)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure(t) for t in b.column(3).to_pylist()]
        long = lambda k: pa.array([r[k] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), b.column(4), *map(long, range(5)), _lists([r[5] for r in rows], 8), _lists([r[6] for r in rows], len(WORDS) + 1)],
            names=[x.split()[0] for x in SCHEMA.split(", ")],
        )


def _judged_by() -> list[Column]:
    """What a verdict depends on besides the doc_id."""
    return [F.col("text").cast("string"), F.col("lang").cast("string")]


def features(docs: DataFrame) -> DataFrame:
    """A row for each document: h1 and h2 (its identity), doc_id, lang, base figures, both histograms, base_failed."""
    doc_id, (text, lang) = F.col("doc_id").cast("long"), _judged_by()
    narrow = docs.select(*identity(doc_id, text, lang), doc_id.alias("doc_id"), text.alias("text"), lang.alias("lang"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return narrow.mapInArrow(_features, SCHEMA).withColumn("base_failed", failed)


def references(feats: DataFrame) -> DataFrame:
    """A row for each language: the mean histograms of its documents that pass the base rules.

    Sums bin by bin, with partial sums before the shuffle: what is shuffled is languages times bins.
    """
    n_word = len(WORDS) + 1
    bins = [(f"c{i}", _at("class_ppm", i)) for i in range(8)] + [(f"w{i}", _at("word_ppm", i)) for i in range(n_word)]
    sums = feats.where(~F.col("base_failed")).groupBy("lang").agg(F.count("*").alias("n"), *(F.sum(x).alias(name) for name, x in bins))
    mean = lambda name: F.floor(F.col(name) / F.col("n")).cast("int")
    return sums.select(F.col("lang").alias("ref_lang"), F.array(*[mean(f"c{i}") for i in range(8)]).alias("class_ref"), F.array(*[mean(f"w{i}") for i in range(n_word)]).alias("word_ref"))


def _at(name: str, i: int) -> Column:
    return F.get(F.col(name), F.lit(i))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits of two histograms in parts per million, 0 to 1.

    p log2(2p / (p + q)) + q log2(2q / (p + q)) is added up over the bins that either has.
    """

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    both = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, v: a + v)) / 2_000_000)


def _distances(feats: DataFrame, refs: DataFrame) -> DataFrame:
    """feats with class_distance and word_distance; 0 where the language has no reference."""
    joined = feats.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    by = {"class_distance": js_distance(F.col("class_ppm"), F.col("class_ref")), "word_distance": js_distance(F.col("word_ppm"), F.col("word_ref"))}
    return joined.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in by.items()}).drop("ref_lang", "class_ref", "word_ref")


def judged(docs: DataFrame, *, max_class: float = 0.145, max_word: float = 0.3, min_words: int = MIN_WORDS, min_common: int = 80) -> DataFrame:
    """features() with both distances and kept.

    max_class, max_word: largest distances of a document that stays.  The references are taken
    twice, the second time from the half of a language's documents that is nearest the first, so that
    junk does not shift them.  min_words: shorter documents are not judged by character classes.
    min_common: nor by common words, when they hold fewer words than this.  max_word lies below the
    distance of a text without any common word (0.39) and is widened by what chance adds to that of
    a text of so many words.  A language without reference (none of its documents passes the base
    rules) rejects nothing beyond the base rules.
    """
    feats = written(features(docs), "quality")
    first = _distances(feats, references(feats)).withColumn("bin", F.floor(1000 * F.col("class_distance")))
    # Distances in thousandths: an exact median that keeps a thousand counts at most.
    half = first.where(~F.col("base_failed")).groupBy("lang").agg(F.percentile("bin", F.lit(0.5)).alias("half")).withColumnRenamed("lang", "half_lang")
    near = first.join(half, F.col("lang").eqNullSafe(F.col("half_lang"))).where(F.col("bin") <= F.col("half"))
    out = _distances(feats, references(near))
    n, words = F.col("n_words"), F.col("word_distance")
    far = ((n >= min_words) & (F.col("class_distance") > max_class)) | ((n >= min_common) & (words * words > max_word * max_word + CHANCE / F.greatest(n, F.lit(1))))
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def score(docs: DataFrame, **limits) -> DataFrame:
    """A row for each document: base figures, both distances, ``base_failed`` and ``kept``."""
    return judged(docs, **limits).select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of documents that pass, in the columns they came in.

    A row finds its verdict by doc_id, text and language, so rows that share a doc_id are judged each
    by its own text, and rows without one like the others.
    """
    # Written, so that the join below has nothing else by its key in its stage.
    good = written(judged(docs, **limits).where("kept").select("h1", "h2").distinct(), "good")
    return unpacked(packed(docs, *identity(F.col("doc_id").cast("long"), *_judged_by())).join(good, ["h1", "h2"], "left_semi"))


def oracle(max_class: float = 0.145, max_word: float = 0.3, min_common: int = 80) -> str:
    """The result of score() in SQL, distances rounded to six digits."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    count = lambda keep: f"length(regexp_replace(t, '[^{keep}]', '', 'g'))"
    common = ", ".join(f"({quoted(w)})" for w in WORDS)
    punct = quoted(PUNCT.decode())
    ws = r"\x20\x09-\x0D"
    classes = {0: count("a-z0-9"), 1: count("A-Z"), 2: count("''\""), 3: count(ws), 4: count(".,;:!?()\\-"), 5: count("#*$%&|<>"), 7: r"length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))"}
    class_rows = " UNION ALL ".join(f"SELECT doc_id, lang, {k} AS bin, {x} AS c, length(t) AS total FROM w" for k, x in classes.items())
    part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2.0 * {x} / ({x} + {y})) ELSE 0 END"

    def refs(name: str, docs: str) -> str:
        return f"""{name}n AS (SELECT lang, count(*) AS n FROM {docs} GROUP BY lang),
    {name} AS (SELECT h.kind, h.lang, h.bin, CAST(floor(sum(h.ppm) / any_value(n)) AS BIGINT) AS q FROM h JOIN {docs} d ON d.doc_id = h.doc_id JOIN {name}n ON {name}n.lang IS NOT DISTINCT FROM h.lang GROUP BY h.kind, h.lang, h.bin)"""

    def distances(name: str, ref: str) -> str:
        return f"""{name} AS (SELECT doc_id, sqrt(greatest(0, coalesce(sum(x) FILTER (kind = 'c'), 0)) / 2e6) AS cd, sqrt(greatest(0, coalesce(sum(x) FILTER (kind = 'w'), 0)) / 2e6) AS wd FROM (
        SELECT coalesce(h.doc_id, g.doc_id) AS doc_id, coalesce(h.kind, g.kind) AS kind, {part('coalesce(h.ppm, 0)', 'coalesce(g.q, 0)')} + {part('coalesce(g.q, 0)', 'coalesce(h.ppm, 0)')} AS x
        FROM (SELECT f.doc_id, r.kind, r.bin, r.q FROM f JOIN {ref} r ON r.lang IS NOT DISTINCT FROM f.lang) g
        FULL JOIN (SELECT h.* FROM h WHERE EXISTS (SELECT 1 FROM {ref} r WHERE r.lang IS NOT DISTINCT FROM h.lang)) h ON h.doc_id = g.doc_id AND h.kind = g.kind AND h.bin = g.bin) GROUP BY 1)"""

    return f"""
    WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{ws}]+') AS ws FROM documents),
    ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
    dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^{ws}]') GROUP BY doc_id),
    tr AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    tp AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tr) x, range(3) y(j) WHERE n > 1),
    rp AS (SELECT doc_id, count(*) AS n FROM tp GROUP BY doc_id),
    f0 AS (SELECT w.doc_id, w.lang, len(ws) AS n_words, length(regexp_replace(t, '[{ws}]+', '', 'g')) AS word_chars, {classes[5]} AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(rp.n, 0) AS n_repeat_words
        FROM w LEFT JOIN dl ON dl.doc_id = w.doc_id LEFT JOIN rp ON rp.doc_id = w.doc_id),
    f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f0),
    cc AS ({class_rows}),
    ca AS (SELECT doc_id, lang, bin, c, total FROM cc UNION ALL SELECT doc_id, lang, 6, any_value(total) - sum(c), any_value(total) FROM cc GROUP BY doc_id, lang),
    cw AS (SELECT word FROM (VALUES {common}) v(word)),
    wu AS (SELECT doc_id, lang, len(ws) AS total, unnest(ws) AS x FROM w),
    wl AS (SELECT *, CASE WHEN x IN (SELECT word FROM cw) THEN x ELSE trim(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {punct}) END AS word FROM wu),
    wc AS (SELECT doc_id, lang, CASE WHEN word IN (SELECT word FROM cw) THEN word ELSE '*' END AS bin, count(*) AS c, any_value(total) AS total FROM wl GROUP BY 1, 2, 3),
    h AS (SELECT 'c' AS kind, doc_id, lang, CAST(bin AS VARCHAR) AS bin, CAST(c * 1000000 // greatest(total, 1) AS BIGINT) AS ppm FROM ca UNION ALL SELECT 'w', doc_id, lang, bin, c * 1000000 // total FROM wc),
    g1 AS (SELECT doc_id, lang FROM f WHERE NOT base_failed),
    {refs('r1', 'g1')},
    {distances('d1', 'r1')},
    b1 AS (SELECT f.doc_id, f.lang, f.base_failed, floor(1000 * coalesce(cd, 0)) AS b FROM f LEFT JOIN d1 ON d1.doc_id = f.doc_id),
    hf AS (SELECT lang, quantile_cont(b, 0.5) AS half FROM b1 WHERE NOT base_failed GROUP BY lang),
    g2 AS (SELECT b1.doc_id, b1.lang FROM b1 JOIN hf ON hf.lang IS NOT DISTINCT FROM b1.lang WHERE NOT base_failed AND b <= half),
    {refs('r2', 'g2')},
    {distances('d2', 'r2')}
    SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(coalesce(cd, 0) + 3.1e-9, 6) AS class_distance, round(coalesce(wd, 0) + 3.1e-9, 6) AS word_distance, base_failed,
           NOT base_failed AND NOT ((n_words >= {MIN_WORDS} AND coalesce(cd, 0) > {max_class}) OR (n_words >= {min_common} AND coalesce(wd, 0) * coalesce(wd, 0) > {max_word * max_word} + {CHANCE} / n_words)) AS kept
    FROM f LEFT JOIN d2 ON d2.doc_id = f.doc_id"""
