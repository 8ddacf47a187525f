"""HTML extraction: a recurrent network labels the text blocks of a page.

A page becomes its sequence of leaf blocks, each with the path of elements above it.  A block's
vector has hashed path elements (names, classes, ids), hashed words, and a few figures.  A
bidirectional LSTM in numpy reads the sequence in both directions, so each block is judged in the
context of the whole page, and labels it main text or not.  The network is trained here, on pages
made by a seeded generator, when it is first needed (a few seconds); its size is fixed.

Markup is read in one pass whose time is proportional to the page, however broken it is.  A page with
more than LONG blocks is read by the network in stretches, so memory holds one stretch beside the text.

Defined results: a null html counts as empty and gives an empty text; very long pages are taken whole;
repeated rows each get a row; a null page_id or url is carried along; an empty table gives an empty
result; other columns are ignored, whatever their names; unclosed elements, comments and scripts end
with the page; a ``<`` that begins no markup is text.
"""

from __future__ import annotations

import bisect
import functools
import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCK = frozenset({"p"})
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg iframe object title textarea select".split())
#: A tag with nothing odd in it; possessive, and it ends at the next < at the latest.
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
MARKS = re.compile("[>\"']")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")

PATH_DIM, WORD_DIM, FIGURES = 128, 32, 6
DIM = PATH_DIM + WORD_DIM + FIGURES
#: Elements of a path that a block's vector tells of: the outermost and the innermost.
OUTER, INNER = 8, 24
#: Blocks that the network reads at once.
LONG = 4096


class Leaf:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


class Scanner:
    """Pieces of markup of a page in order: (start, end, closing, tag, attributes), tag None for comments and the like."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.marks: list[int] | None = None
        self.hopeless: set[int] = set()

    def quoted_end(self, at: int) -> int:
        """Where the > is that ends a tag, outside quotes, or -1.  A place once found to lead nowhere is not followed again."""
        if self.marks is None:
            self.marks = [m.start() for m in MARKS.finditer(self.page)]
        way = []
        while at not in self.hopeless:
            way.append(at)
            i = bisect.bisect_left(self.marks, at)
            if i == len(self.marks):
                break
            at = self.marks[i]
            mark = self.page[at]
            if mark == ">":
                return at
            if at >= self.last[mark]:
                break
            at = self.page.find(mark, at + 1) + 1
        self.hopeless.update(way)
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, bool, str | None, str]]:
        page, at, n = self.page, self.page.find("<"), len(self.page)
        while at >= 0:
            end, closing, tag, attributes = 0, False, None, ""
            if m := TAG.match(page, at):
                end, closing, tag, attributes = m.end(), bool(m[1]), m[2].lower(), m[3]
            elif page.startswith("<!--", at):
                end = page.find("-->", at + 4) + 3 if page.find("-->", at + 4) >= 0 else n
            elif page[at + 1 : at + 2] in ("!", "?"):
                end = page.find(">", at) + 1 or n
            elif at < self.last[">"] and (m := NAME.match(page, at)):
                stop = self.quoted_end(m.end())
                stop = stop if stop >= 0 else page.find(">", m.end())
                end, closing, tag, attributes = stop + 1, bool(m[1]), m[2].lower(), page[m.end() : stop]
            if end:
                if tag in RAW and not closing:
                    m = _ends(tag).search(page, end)
                    end, tag = m.end() if m else n, None
                yield at, end, closing, tag, attributes
            at = page.find("<", end or at + 1)


@functools.cache
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*+>", re.I)


def leaves(page: str | None) -> list[Leaf]:
    """The text blocks of a page in order: references decoded, white space within a block made one."""
    page = page or ""
    stack: list[tuple[str, str]] = []
    opened: Counter[str] = Counter()
    out: list[Leaf] = []
    parts: list[str] = []
    at: tuple[str, ...] = ()
    linked = last = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Leaf(at, text, linked))
            parts, linked = [], 0

    def take(raw: str) -> None:
        nonlocal at, linked
        text = html.unescape(raw) if "&" in raw else raw
        if text and (parts or not text.isspace()):
            if not parts:
                ends = stack if len(stack) <= OUTER + INNER else stack[:OUTER] + stack[-INNER:]
                at = tuple(label for _, label in ends)
            parts.append(text)
            linked += len(text) if opened["a"] else 0

    def close_to(i: int) -> None:
        opened.subtract(t for t, _ in stack[i:])
        del stack[i:]

    for start, end, closing, tag, attributes in Scanner(page):
        if start > last:
            take(page[last:start])
        last = end
        if tag is None:
            continue
        block = tag not in INLINE
        if block:
            flush()
        elif tag == "br" and parts:
            parts.append(" ")
        if closing:
            if opened[tag] > 0:
                close_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if block:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSED_BY_BLOCK or stack[i][0] in SIBLINGS.get(tag, ()):
                    close_to(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower() if attributes else ""
        stack.append((tag, f"{tag} {names}" if names else tag))
        opened[tag] += 1
    if last < len(page):
        take(page[last:])
    flush()
    return out


def _hashed(token: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    return h % dim, 1.0 if h & 0x10000 else -1.0


@functools.lru_cache(maxsize=20_000)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIM, np.float32)
    for label in path:
        tag, _, names = label.partition(" ")
        for token in {tag} | {f".{p}" for p in PART.findall(names)}:
            i, sign = _hashed(token, PATH_DIM)
            v[i] += sign
    return np.clip(v, -2, 2)


def vectors(page: list[Leaf], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Vectors of the blocks lo to hi of a page."""
    some = page[lo:hi] if lo or hi is not None else page
    x = np.zeros((len(some), DIM), np.float32)
    for k, leaf in enumerate(some):
        x[k, :PATH_DIM] = path_vector(leaf.path)
        raw = leaf.text.lower().encode("utf-8", "surrogatepass")
        words = raw.split()
        bins = np.bincount([zlib.crc32(w) & (WORD_DIM - 1) for w in words], minlength=WORD_DIM)
        n = len(words)
        x[k, PATH_DIM : PATH_DIM + WORD_DIM] = bins / (n + 8)
        stops = raw.count(b".") + raw.count(b",")
        x[k, -FIGURES:] = (min(n, 60) / 30, np.log1p(n) / 4, leaf.linked / len(leaf.text), stops / (n + 4), (lo + k + 1) / len(page), 1 / (lo + k + 1))
    return x


class Network:
    """Bidirectional LSTM with a logistic output for each position; sequences are batched and padded."""

    def __init__(self, hidden: int = 24, seed: int = 1):
        r = np.random.default_rng(seed)
        scale = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.h = hidden
        self.p = {"out": scale(2 * hidden, 1), "bias": np.zeros(1, np.float32)}
        for d in ("f", "b"):
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # forget gates begin open
            self.p |= {f"x{d}": scale(DIM, 4 * hidden), f"h{d}": scale(hidden, 4 * hidden), f"c{d}": bias}

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, start: tuple | None = None) -> tuple[np.ndarray, list, tuple]:
        """x: time, batch, DIM; mask: time, batch, 1.  Hidden states, what the backward pass needs, and the state at the end."""
        n, b, _ = x.shape
        hid, (h, c) = self.h, start or (np.zeros((b, self.h), np.float32), np.zeros((b, self.h), np.float32))
        z = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        out, tape = np.zeros((n, b, hid), np.float32), []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            g = z[t] + h @ self.p[f"h{d}"]
            gates = 1 / (1 + np.exp(-np.clip(g[:, : 3 * hid], -30, 30)))
            i, f, o, u = gates[:, :hid], gates[:, hid : 2 * hid], gates[:, 2 * hid :], np.tanh(g[:, 3 * hid :])
            new = f * c + i * u
            tc = np.tanh(new)
            if keep:
                tape.append((t, h, c, i, f, o, u, tc))
            m = mask[t]
            c, h = m * new + (1 - m) * c, m * (o * tc) + (1 - m) * h
            out[t] = h
        return out, tape, (h, c)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return (both @ self.p["out"] + self.p["bias"])[..., 0]

    def logits_of(self, page: list[Leaf], at_once: int = LONG) -> np.ndarray:
        """The same for one page of any length, read in stretches that hand on their state."""
        out, ones = np.full(len(page), self.p["bias"][0], np.float32), np.ones((at_once, 1, 1), np.float32)
        for k, d in enumerate("fb"):
            state, w = None, self.p["out"][k * self.h : (k + 1) * self.h, 0]
            starts = range(0, len(page), at_once)
            for lo in starts if d == "f" else reversed(starts):
                x = vectors(page, lo, lo + at_once)[:, None]
                hidden, _, state = self.run(x, ones[: len(x)], d, False, state)
                out[lo : lo + at_once] += hidden[:, 0] @ w
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        runs = {d: self.run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        p = 1 / (1 + np.exp(-np.clip((both @ self.p["out"] + self.p["bias"])[..., 0], -30, 30)))
        m = mask[..., 0]
        total = m.sum()
        loss = float(-(m * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        e = (m * (p - y) / total)[..., None].astype(np.float32)
        g = {"out": np.tensordot(both, e, ([0, 1], [0, 1])), "bias": e.sum((0, 1))}
        back, hid = e @ self.p["out"].T, self.h
        for k, d in enumerate("fb"):
            own, dz = back[..., k * hid : (k + 1) * hid], np.zeros((*x.shape[:2], 4 * hid), np.float32)
            dh = dc = np.zeros((x.shape[1], hid), np.float32)
            w, gw = self.p[f"h{d}"], np.zeros_like(self.p[f"h{d}"])
            for t, h0, c0, i, f, o, u, tc in reversed(runs[d][1]):
                mt = mask[t]
                dh = dh + own[t]
                a, ca = mt * dh, mt * dc
                dcell = ca + a * o * (1 - tc * tc)
                dg = np.concatenate((dcell * u * i * (1 - i), dcell * c0 * f * (1 - f), a * tc * o * (1 - o), dcell * i * (1 - u * u)), axis=1)
                dz[t] = dg
                gw += h0.T @ dg
                dh, dc = (1 - mt) * dh + dg @ w.T, (1 - mt) * dc + dcell * f
            g |= {f"x{d}": np.tensordot(x, dz, ([0, 1], [0, 1])), f"h{d}": gw, f"c{d}": dz.sum((0, 1))}
        return loss, g


def padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, seqs))
    x, mask = np.zeros((n, len(seqs), DIM), np.float32), np.zeros((n, len(seqs), 1), np.float32)
    for k, s in enumerate(seqs):
        x[: len(s), k], mask[: len(s), k] = s, 1
    return x, mask


def fit(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 48, rate: float = 0.01, seed: int = 3) -> Network:
    """Adam on pages of (vectors, labels); the rate falls with the epochs."""
    net, r, step = Network(), np.random.default_rng(seed), 0
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    var = {k: np.zeros_like(v) for k, v in net.p.items()}
    for epoch in range(epochs):
        order = r.permutation(len(pages))
        for at in range(0, len(order), batch):
            some = sorted((pages[i] for i in order[at : at + batch]), key=lambda p: len(p[0]))
            x, mask = padded([v for v, _ in some])
            y = padded([np.repeat(lab[:, None], DIM, 1) for _, lab in some])[0][..., 0]
            _, g = net.gradients(x, mask, y)
            step += 1
            for k, v in g.items():
                v = np.clip(v, -1, 1)
                mean[k], var[k] = 0.9 * mean[k] + 0.1 * v, 0.999 * var[k] + 0.001 * v * v
                net.p[k] -= (rate * 0.6**epoch * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


# What marks the parts of the made pages.
MAIN = ["<article>", "<main>", '<div id="content">', '<div class="post-content">', '<div class="entry">', '<section class="article-body">', '<div class="story" role="main">', "<main><article>"]
ASIDE = {
    "nav": ["<nav>", '<div class="menu">', '<ul id="navigation">', '<div role="navigation" class="navbar">', '<div class="breadcrumbs">', '<div class="pagination">'],
    "header": ["<header>", '<div id="header">', '<div class="masthead banner">', '<header class="site-header">', '<div class="topbar">'],
    "footer": ["<footer>", '<div id="footer">', '<div class="site-footer copyright">', '<footer class="footer">'],
    "side": ["<aside>", '<div class="sidebar">', '<div id="sidebar" class="widget">', '<aside class="related">', '<div class="related-posts">', '<div class="social share">'],
    "notice": ['<div class="notice">', '<div class="cookie-banner">', '<div id="cookie" role="alert">', '<div class="alert message">', '<div class="gdpr consent">', '<div class="newsletter subscribe">', '<p class="notice">'],
    "ad": ['<div class="ad">', '<div class="ads advert">', '<div class="advertisement">', '<aside class="promo sponsored">', '<div id="ad-slot" class="banner-ad">', '<p class="ad">'],
    "form": ["<form>", '<form class="search">', '<form id="signup">', '<div class="login"><form>'],
    "comments": ['<section id="comments">', '<div class="comments">', '<ol class="commentlist">', '<div id="disqus" class="comment-thread">', '<section class="reader-comments">'],
}


def made_page(r: random.Random) -> tuple[str, list[int]]:
    """A page and the labels of its blocks, in the order of leaves()."""
    out, labels = ["<html><head><title>t</title></head><body>"], []
    letters = "aeiounrstlmdhéñü"

    def text(n: int) -> str:
        ws = ["".join(r.choices(letters, k=r.randint(1, 9))) + r.choice(["", "", "", "", ",", "."]) for _ in range(n)]
        return " ".join(ws)

    def closing(opened: str) -> str:
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z]+)", opened)))

    def block(tag: str, n: int, label: int, inner: str = "") -> None:
        out.append(f"<{tag}>{inner}{text(n)}{f'</{inner[1:]}' if inner else ''}" + (f"</{tag.split()[0]}>" if tag != "p" or r.random() < 0.7 else ""))
        labels.append(label)

    def outside(kind: str) -> None:
        opened = r.choice(ASIDE[kind])
        out.append(opened)
        if opened.startswith("<p"):
            out.append(text(r.randint(2, 25)))
            labels.append(0)
        else:
            for _ in range(r.randint(1, 4 if kind != "comments" else 6)):
                tag = r.choice({"nav": ["li", "li", "div"], "comments": ["div class=\"comment\"", "li", "p"], "form": ["div", "p"], "header": ["div", "h1", "p"]}.get(kind, ["p", "div", "li", "h3"]))
                n = r.randint(1, 4) if kind in ("nav", "form") else r.randint(2, 40)
                block(tag, n, 0, "<a>" if kind == "nav" or r.random() < 0.2 else "")
                if tag == "p":
                    out.append("</p>")
            if r.random() < 0.3 and not opened.startswith("<ul") and not opened.startswith("<ol"):
                out.append(text(r.randint(1, 12)))
                labels.append(0)
        out.append(closing(opened))

    for kind in ("header", "nav", "notice", "ad"):
        if r.random() < 0.55:
            outside(kind)
    opened = r.choice(MAIN)
    out.append(opened)
    if r.random() < 0.8:
        block("h1", r.randint(1, 12), 1)
    for _ in range(r.choice([1, 1, 2, 3, 5, 8])):
        kind = r.random()
        if kind < 0.62:
            block("p", r.randint(1, 90), 1, "<b>" if r.random() < 0.2 else "")
        elif kind < 0.7:
            block(r.choice(["h2", "h3", "blockquote", "pre", "div", "td", "figcaption"]), r.randint(1, 25), 1)
        elif kind < 0.78:
            out.append("<ul>")
            for _ in range(r.randint(1, 4)):
                block("li", r.randint(1, 15), 1, "<a>" if r.random() < 0.2 else "")
            out.append("</ul>")
        elif kind < 0.9:
            outside(r.choice(["ad", "ad", "notice", "side", "form", "nav", "header", "footer"]))
        else:
            out.append(f"<p><b>{text(r.randint(1, 15))}<br>")
            labels.append(1)
    if r.random() < 0.2:
        outside("comments")
    out.append(closing(opened))
    for kind in ("comments", "side", "form", "ad", "footer"):
        if r.random() < 0.5:
            outside(kind)
    return "".join(out) + ("</body></html>" if r.random() < 0.8 else ""), labels


def made_pages(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    r, out = random.Random(seed), []
    while len(out) < n:
        page, labels = made_page(r)
        found = leaves(page)
        if len(found) == len(labels):
            out.append((vectors(found), np.array(labels, np.float32)))
    return out


@functools.cache
def trained(n_pages: int = 4000) -> Network:
    return fit(made_pages(n_pages, seed=5))


def extract(pages: DataFrame, net: Network | None = None, *, at_once: int = 256) -> DataFrame:
    """A row for each page: page_id, url, text (main blocks, one a line), n_chars."""
    weights = (net or trained()).p

    def label(group: list[list[Leaf]], model: Network) -> list[str]:
        texts = [""] * len(group)
        for i, g in enumerate(group):
            if len(g) > LONG:
                texts[i] = "\n".join(leaf.text for leaf, x in zip(g, model.logits_of(g)) if x > 0)
        full = sorted((i for i, g in enumerate(group) if 0 < len(g) <= LONG), key=lambda i: len(group[i]))
        at = 0
        while at < len(full):  # pages of like length share a batch; a batch has a bounded number of blocks
            n = max(1, min(at_once, 40_000 // max(1, len(group[full[min(len(full) - 1, at + at_once - 1)]]))))
            some = full[at : at + n]
            main = model.logits(*padded([vectors(group[i]) for i in some])) > 0
            for k, i in enumerate(some):
                texts[i] = "\n".join(leaf.text for t, leaf in enumerate(group[i]) if main[t, k])
            at += n
        return texts

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network()
        model.p = weights
        for b in batches:
            for lo in range(0, b.num_rows, 4 * at_once):
                some = b.slice(lo, 4 * at_once)
                texts = label([leaves(x) for x in some.column(2).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(each, "page_id long, url string, text string, n_chars long")
