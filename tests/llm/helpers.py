"""Small tables with every odd case, and brute-force versions."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from tidemark.llm import decontam, quality

#: Beside the columns of documents, ones named like results, like what the operators use inside, and oddly.
CLASHING = "kept size shard key slot law h1 h2 row first_of lang_ node bucket comp component group_id __key __rank __size __bucket __row a.b c`d".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in CLASHING)


def rows(*texts, first: int = 0, lang="en", source="s"):
    return [(first + i, t, lang, source, len(t or ""), *CLASHING) for i, t in enumerate(texts)]


def odd_docs(spark, texts=()):
    """Nulls in every column, empty and long texts, repeated rows, shared ids of different texts, and columns whose names clash."""
    long = "the quick brown fox and the lazy dog of it in that is " * 4000
    out = rows(*texts, "", " \t\n ", long, "the same text of some words in it", "the same text of some words in it", None, "x", "naïve café ÉTÉ 日本   end")
    nulls = (None,) * (2 + len(CLASHING))
    out += [out[0], out[3], (None, "no id", None, None, *nulls[1:]), (None, None, None, None, *nulls[1:]), (None, "no id", "en", "s", *nulls[1:]), (99, "a null source", None, None, *nulls[1:])]
    out += rows("one text of a shared id, with words enough", first=99) + rows("one text of a shared id, with words enough", first=100) + rows("another text that stands alone under its id", first=100)
    return spark.createDataFrame(out, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def brute_one_of_each(pairs, percent, k):
    """Of (doc_id, text), the rows that stay: of each component of texts that of the smallest id (null last); wordless texts are alone."""
    texts = sorted({t for _, t in pairs if shingle_set(t, k)})
    comps = brute_components(list(enumerate(texts)), percent, k)
    first = {}
    for i, t in pairs:
        if shingle_set(t, k):
            c = comps[texts.index(t)]
            first[c] = min(first.get(c, (True, 0)), (i is None, i or 0))
    return sorted([*first.values(), *{(i is None, i or 0, t) for i, t in pairs if not shingle_set(t, k)}], key=str)


def shingle_set(text, k):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return frozenset()
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)])


def brute_components(pairs, percent, k):
    """doc_id -> smallest doc_id reachable by links between distinct texts, over (doc_id, text)."""
    sets = [(i, shingle_set(t, k)) for i, t in pairs]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            n = len(s & t)
            if n and 100 * n >= percent * (len(s) + len(t) - n):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def base_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def kept_by_hand(rows):
    """(class distance, word distance, kept) of each (text, lang), by the rules as they are told."""
    common, classes = [w.encode() for w in quality.WORDS], [set(range(97, 123)) | set(range(48, 58)), set(range(65, 91)), set(b"'\""), set(b" \t\n\x0b\x0c\r"), set(b".,;:!?()-"), set(b"#*$%&|<>")]
    hists, good = [], []
    for text, _ in rows:
        chars, words = Counter(), Counter()
        for c in text or "":
            k = next((i for i, some in enumerate(classes) if ord(c) in some), 7 if ord(c) > 127 else 6)
            chars[k] += 1
        for w in (text or "").encode().split():
            w = w if w in common else w.lower().strip(b".,;:!?'\"()-#*$%&|<>")
            words[w if w in common else None] += 1
        ppm = lambda c, bins: np.array([c[b] * 1_000_000 // max(1, sum(c.values())) for b in bins])
        hists.append((ppm(chars, range(8)), ppm(words, [*common, None])))
        good.append(not base_by_hand(text)[-1])

    def refs(which):
        out = {}
        for lang in {lang for _, lang in rows}:
            own = [i for i in which if rows[i][1] == lang]
            if own:
                out[lang] = [np.sum([hists[i][k] for i in own], axis=0) // len(own) for k in (0, 1)]
        return out

    def distance(p, q):
        p, q = p.astype(float), q.astype(float)
        part = lambda a, b: sum(x * np.log2(2 * x / (x + y)) for x, y in zip(a, b) if x > 0)
        return np.sqrt(max(0, part(p, q) + part(q, p)) / 2_000_000)

    passing = [i for i, ok in enumerate(good) if ok]
    first = refs(passing)
    bins = {i: int(np.floor(1000 * distance(hists[i][0], first[rows[i][1]][0]))) for i in passing}
    half = {lang: np.median([bins[i] for i in passing if rows[i][1] == lang]) for lang in first}
    second, out = refs([i for i in passing if bins[i] <= half[rows[i][1]]]), []
    for i, (text, lang) in enumerate(rows):
        c, w = (distance(hists[i][k], second[lang][k]) if lang in second else 0.0 for k in (0, 1))
        n = base_by_hand(text)[0]
        out.append((c, w, good[i] and c <= 0.145 and (n < 80 or w * w <= 0.09 + 4.328 / n)))
    return out


def targets_by_hand(sizes, share=1.5, cap=2.0):
    """Share by weight; cap those above; share what is left among the others, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > cap * sizes[s]]
        if not over:
            return out | part
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def tokens_by_hand(text, names_at_heads):
    """(token, value) of each word; value is None for a literal one."""
    out, head, number = [], True, False
    for w in (text or "").split():
        bare = w.strip(decontam.EDGES)
        is_number = bool(decontam.NUMBER.fullmatch(bare))
        name = len(bare) > 1 and bare[0].isupper() and bare[1:].islower()
        if is_number:
            out.append(("<n>", bare.lower()))
        elif bare.lower() in decontam.UNITS:
            out.append(("<u>", bare.lower()) if number else (bare.lower(), None))
        elif name and (names_at_heads or not head):
            out.append(("<p>", bare.lower()))
        else:
            out.append((bare.lower(), None))
        number, head = is_number, w.rstrip("\"')]”’»")[-1:] in tuple(".!?:")
    return out


def windows_by_hand(text, sizes, exact_sizes):
    """{canonical tokens: [(place, values)]} of a text's windows that count."""
    found = {}
    plain, named = tokens_by_hand(text, False), tokens_by_hand(text, True)
    for ts in (plain, named) if named != plain else (plain,):
        for n in sizes:
            for i in range(len(ts) - n + 1):
                w = ts[i : i + n]
                if sum(v is None for _, v in w) >= 5:
                    found.setdefault(tuple(t for t, _ in w), set()).add((i, tuple(v for _, v in w if v is not None)))
    for n in exact_sizes:
        if n >= 4:
            ws = [v or t for t, v in plain]
            for i in range(len(ws) - n + 1):
                found.setdefault(("word for word", *ws[i : i + n]), set()).add((i, ()))
    return found


def contaminated_by_hand(docs, bench, least=0.5, consistent=0.75):
    """(doc, item) pairs of positions."""
    items = []
    for text in bench:
        n = len((text or "").split())
        w = windows_by_hand(text, [8], [])
        items.append(w or windows_by_hand(text, [n], [n]))
    alone = {len((t or "").split()) for t in bench if t and not windows_by_hand(t, [8], [])}
    got = set()
    for d, text in enumerate(docs):
        own = windows_by_hand(text, {8, *alone}, alone)
        for k, item in enumerate(items):
            hits = sorted({(p - q, q, p, values, theirs) for w, at in item.items() for q, theirs in at for p, values in own.get(w, ())})
            total = len({q for at in item.values() for q, _ in at})
            runs, last = [], None
            for h in hits:
                if last is None or h[0] - last > 3:
                    runs.append([])
                last = h[0]
                runs[-1].append(h)
            for run in [*runs, hits]:
                held = {}
                for h in sorted(run, key=lambda h: (h[2], h[3], h[4])):
                    held.setdefault(h[1], h)
                if total and held and len(held) >= least * total:
                    stand = {}
                    for *_, values, theirs in held.values():
                        for mine, its in zip(values, theirs):
                            stand.setdefault(its, set()).add(mine)
                    if sum(len(v) == 1 for v in stand.values()) >= consistent * len(stand):
                        got.add((d, k))
    return got
