"""Plain forms of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def byte_repeats(docs, width):
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[s : s + width] for _, b in texts for s in range(len(b) - width + 1))
    out = []
    for d, b in texts:
        gone = [False] * len(b)
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1:
                gone[s : s + width] = [True] * width
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def word_repeats(docs, width):
    order = lambda d: (d is not None, d or 0)
    texts = [(d, words_of(t)) for d, t in docs]
    first = {}
    for d, w in texts:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(order(d), first.get(k, order(d)))
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < order(d):
                gone[s : s + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(words, n):
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def near_groups(docs, percent=75, n=5):
    sets = [shingles(words_of(fold(t)), n) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x] if j > i)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[root(i)].append(docs[i][0])
    return [(d, len(sets[i]), min(groups[root(i)])) for i, (d, _) in enumerate(docs)]


def leaks(text, items, n=5, similarity=0.75):
    """{item: best weighted similarity} over windows of the item's size."""
    words, out = words_of(fold(text)), {}
    for item, body in items:
        own = words_of(fold(body))
        if not own:
            continue
        length = min(n, len(own))
        grams = lambda w: Counter(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
        target = grams(own)
        for s in range(len(words) - len(own) + 1):
            window = grams(words[s : s + len(own)])
            common = (window & target).total()
            value = common / (2 * target.total() - common)
            if value >= similarity:
                out[item] = max(value, out.get(item, 0))
    return out


def whole_leaks(text, items, n=5, similarity=0.75):
    """{item: weighted similarity} of the whole text, from the definition: common shingles by all shingles."""
    words, out = words_of(fold(text)), {}
    for item, body in items:
        own = words_of(fold(body))
        length = min(n, len(own))
        a, b = (Counter(tuple(w[i : i + length]) for i in range(len(w) - length + 1)) for w in (words, own))
        value = (a & b).total() / (a | b).total() if own and a else 0
        if value >= similarity:
            out[item] = max(value, out.get(item, 0))
    return out


def ppm_bits(sample, text, order):
    """Code length of ``text`` under one language's context trees, escape method C."""
    counts = defaultdict(Counter)
    for t in sample:
        b = b"\n" * order + fold(t).encode()
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[b[i - k : i]][b[i]] += 1
    b, bits = b"\n" * order + fold(text).encode(), 0.0
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            c = counts.get(b[i - k : i])
            if not c:
                continue
            total = c.total() + len(c)
            if b[i] in c:
                bits -= np.log2(c[b[i]] / total)
                break
            bits -= np.log2(len(c) / total)
        else:
            bits += 8
    return bits
