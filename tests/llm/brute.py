"""Plain versions of the operators, for small tables."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, size):
    w = WORD.findall(low(t))
    if len(w) >= size:
        return frozenset(zip(*[w[i:] for i in range(size)]))
    return frozenset([tuple(w)]) if w else frozenset()


def components(nodes, edges):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def near_dedup(rows, size, percent):
    """(id, n, component, kept) of rows (id, text), ids not null."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    links = []
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links.append((i, j))
    c = components({i for i, _ in sets}, links)
    return [(i, len(s), c[i], c[i] == i) for i, s in sets]


def repeated_bytes(rows, length):
    """(id, kept bytes, removed, runs) of rows (id, text)."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + length] for _, b in raw for s in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((i, kept, sum(gone), sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))))
    return out


def sentences(text):
    """Sentences of a text as (lower-cased words, bytes with the space up to the next sentence)."""
    t = text or ""
    words = list(WORD.finditer(t))
    out, first = [], 0
    for i, w in enumerate(words):
        last = i + 1 == len(words)
        if last or re.search("(?:[.!?][\"')\\]}]?|[。！？])$", w[0]) or "\n" in t[w.end() : words[i + 1].start()]:
            stop = len(t) if last else words[i + 1].start()
            out.append(([low(x[0]) for x in words[first : i + 1]], t[words[first].start() : stop]))
            first = i + 1
    return out


def sentence_spans(rows, least, words):
    """(id, sentences, removed, bytes removed) of distinct rows (id, text), null ids last."""
    seen, out = {}, []
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        own = sentences(t)
        gone = set()
        for a in range(len(own)):
            for b in range(a + least, len(own) + 1):
                span = tuple(w for x, _ in own[a:b] for w in x)
                if len(span) >= words:
                    if seen.setdefault(span, (i, t, a)) != (i, t, a):
                        gone |= set(range(a, b))
                    break
        out.append((i, len(own), len(gone), sum(len(own[k][1].encode()) for k in gone)))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def targets(sizes, weights, most):
    """Target of each source of {name: size}, by the rounds that the rule describes."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in rest) if rest else 0
        above = [s for s in rest if weight[s] * level > most * sizes[s] + 1e-9]
        if not above:
            return {**full, **{s: weight[s] * level for s in rest}}
        full |= {s: most * sizes[s] for s in above}
