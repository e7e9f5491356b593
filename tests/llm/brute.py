"""Brute-force versions of the operators, for small tables."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

words_of = re.compile("[^\x20\x09-\x0d]+").findall


def passages(rows, window=20):
    """(id, text) in order -> {id: (n_words, n_removed, kept)}"""
    seen, out = set(), {}
    for i, t in rows:
        w = words_of(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            one = tuple(w[s : s + window])
            if one in seen:
                gone[s : s + window] = [True] * window
            seen.add(one)
        out[i] = len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)
    return out


def lines(rows, t=Fraction(4, 5)):
    """(id, text) in order -> {id: (n_lines, n_removed, kept)}"""
    before, out = defaultdict(list), {}
    for i, text in rows:
        kept, all_lines = [], [] if text is None else text.split("\n")
        for line in all_lines:
            s = frozenset(words_of(line))
            if s:
                n = len(s)
                near = any(len(s & o) >= t * len(s | o) for m in range(int(n * t), int(n / t) + 2) for o in before[m])
                before[n].append(s)
                if near:
                    continue
            kept.append(line)
        out[i] = len(all_lines), len(all_lines) - len(kept), None if text is None else "\n".join(kept)
    return out


def connected(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def containment(docs, items, n=5, t=Fraction(4, 5)):
    """{(doc, item): (shingles, found)}"""

    def grams(text):
        w = words_of((text or "").lower())
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    sets = [(i, grams(x)) for i, x in items]
    out = {}
    for d, x in docs:
        own = grams(x)
        for i, s in sets:
            if s and len(s & own) >= t * len(s):
                out[d, i] = len(s), len(s & own)
    return out


def near_classes(rows, t=Fraction(4, 5)):
    """(id, text) -> {id: smallest id of its class}, links: weighted Jaccard of all pairs over counts of shingles times idf.

    idf: 16 sixteenths and as many more as the binary logarithm of the shingle's share of all says, 16 more at most.
    """
    each = []
    for _, text in rows:
        w = words_of((text or "").lower())
        k = min(5, len(w))
        each.append(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter())
    n = Counter(s for c in each for s in c)
    total = sum(n.values())
    idf = {s: 16 + (16 if m < max(2, total >> 16) else min(16, max(0, round(-math.log2(m / total))))) for s, m in n.items()}
    weights = [{s: tf * idf[s] for s, tf in c.items()} for c in each]
    sums = [sum(w.values()) for w in weights]
    links = []
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            u, v = sorted((weights[a], weights[b]), key=len)
            low = sum(min(x, v[s]) for s, x in u.items() if s in v)
            if low and low >= t * (sums[a] + sums[b] - low):
                links.append((rows[a][0], rows[b][0]))
    return connected([i for i, _ in rows], links), len(links)
