"""Secret scan: base patterns, and character Markov models compared by log-likelihood ratio.

Two bigram models over classes of characters, one of random strings and one of ordinary
identifiers, are trained from labelled samples.  A long unbroken token is reported as ``markov``
when the ratio of its likelihoods speaks for the random model, in sum and per character.

Defined results: a null text counts as empty; very long texts are scanned whole, one at a time; a null
doc_id is carried along; repeated rows each get a row; an empty table gives an empty result; other
columns are ignored, whatever their names.  The digest of no spans is that of the empty string.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "markov")

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"


def _only(chars: str) -> bytes:
    keep = set(chars.encode())
    return bytes(97 if i in keep else 32 for i in range(256))


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_IS_HEX, _IS_TOKEN = _only(_DIGITS + "abcdef"), _only(_DIGITS + _LOWER + _LOWER.upper() + "+/_=-")
_HEX_RUN, _TOKEN_RUN = b"a" * 32, b"a" * 20

#: Characters of tokens, 0 to 66; 67 is the edge of a token.
ALPHABET = _DIGITS + _LOWER + _LOWER.upper() + "+/_=-"
EDGE = len(ALPHABET)
_CODE = np.full(256, EDGE, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(EDGE)


def fit(samples: Iterable[tuple[str, int]], smoothing: float = 0.5) -> np.ndarray:
    """log2 P(next | this, random) - log2 P(next | this, identifier), from (token, 1 if random).

    A table of fixed size, whatever the number of samples.
    """
    counts = np.full((2, EDGE + 1, EDGE + 1), smoothing)
    for token, label in samples:
        c = np.concatenate(([EDGE], _CODE[np.frombuffer(token.encode("ascii", "ignore"), np.uint8)], [EDGE]))
        np.add.at(counts[int(bool(label))], (c[:-1], c[1:]), 1)
    p = np.log2(counts / counts.sum(axis=2, keepdims=True))
    return p[1] - p[0]


def ratio(token: str, table: np.ndarray) -> float:
    """The log-likelihood ratio of a token in bits; above 0 speaks for a random string."""
    c = np.concatenate(([EDGE], _CODE[np.frombuffer(token.encode(), np.uint8)], [EDGE]))
    return float(table[c[:-1], c[1:]].sum())


def random_strings(n: int = 3000, seed: int = 7) -> list[str]:
    """Labelled sample of random strings: hexadecimal, base 64 and alphanumeric, 16 to 64 long."""
    r = random.Random(seed)
    kinds = (_DIGITS + "abcdef", ALPHABET[:-3], _DIGITS + _LOWER + _LOWER.upper(), _DIGITS + _LOWER, _DIGITS + _LOWER.upper())
    return ["".join(r.choices(kinds[i % len(kinds)], k=r.randint(16, 64))) for i in range(n)]


def identifiers(words: list[str], n: int = 3000, seed: int = 8) -> list[str]:
    """Labelled sample of ordinary identifiers: words alone and joined as code and paths join them."""
    r = random.Random(seed)
    words = [w for w in words if w.isascii() and w.isalpha()] or "the count of all items in user name list is value index path file".split()
    out = []
    for i in range(n):
        ws = [r.choice(words) for _ in range(r.randint(1, 5))]
        sep = "_-/ "[i % 4].strip()
        out.append(sep.join(ws) if sep else "".join(w.capitalize() for w in ws))
        if i % 7 == 0:
            out[-1] += str(r.randint(0, 2030))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in code points, end exclusive."""
    found = []
    low = text.lower() if text.isascii() else text.translate(_ASCII_LOWER)
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if _HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_IS_HEX):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def markov_spans(text: str, table: np.ndarray, least_sum: float, least_mean: float) -> list[tuple[int, int, str]]:
    if _TOKEN_RUN not in text.encode("utf-8", "surrogatepass").translate(_IS_TOKEN):
        return []
    found = []
    for m in TOKEN.finditer(text):
        llr = ratio(m[0], table)
        if llr >= least_sum and llr >= least_mean * len(m[0]):
            found.append((m.start(), m.end(), "markov"))
    return found


def scan(text: str | None, table: np.ndarray, least_sum: float = 12.0, least_mean: float = 0.5) -> tuple[list, list]:
    """Base spans and all spans of one whole text.  A markov span that touches a base span is left out."""
    text = text or ""
    base = sorted(base_spans(text), key=lambda s: (s[0], KINDS.index(s[2])))
    more = untouched(markov_spans(text, table, least_sum, least_mean), base)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def untouched(spans: list[tuple[int, int, str]], by: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans that overlap none of by; both are in the order of their starts, and one pass goes over them."""
    out, i, reach = [], 0, -1
    for span in spans:
        while i < len(by) and by[i][0] < span[1]:
            reach = max(reach, by[i][1])
            i += 1
        if reach <= span[0]:
            out.append(span)
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, table: np.ndarray, **limits) -> DataFrame:
    """A row for each document with counts by kind and its spans."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, spans = scan(text, table, **limits)
                kinds = [k for *_, k in spans]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = [[r[k] for r in rows] for k in range(6)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, SCHEMA)


def sample_words(docs: DataFrame, n_docs: int = 200, n_words: int = 20_000) -> list[str]:
    """Words of the n_docs documents whose doc_id has the smallest hash, for the labelled sample of identifiers.

    Both bounds are parameters; the sample does not grow with the table.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs)
    chosen = [r.doc_id for r in ids.collect()]
    if not chosen:
        return []
    words = docs.where(F.col("doc_id").isin(chosen)).select(F.explode(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]{4,}"), 0)).alias("w"))
    return [r.w for r in words.distinct().orderBy(F.xxhash64("w"), "w").limit(n_words).collect()]


def trained(docs: DataFrame) -> np.ndarray:
    words = sample_words(docs)
    return fit([(t, 1) for t in random_strings()] + [(t, 0) for t in identifiers(words)])
