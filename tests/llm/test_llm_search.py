"""Divergence of sources, exact vector search and ranked lexical search against their plain forms."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from brute import fold
from pyspark.sql import functions as F

from shelfwise.llm import divergence, lexical_search, vector_search
from shelfwise.llm.terms import LETTERS, LETTERS_DIGITS, terms

CLASH = ("id", "query", "block", "row", "rank", "n", "terms", "lead", "item", "chunk", "bit", "total", "width", "p", "copies")
LETTER_RUN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
TERM_RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, columns).withColumns({c: F.lit("x") for c in CLASH})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def last(n):
    """A null id stands behind all others."""
    return (n is None, n or 0)


@pytest.fixture(params=["10000", "3"])
def batches(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, "10000")


@pytest.mark.parametrize("pattern, table", [(LETTER_RUN, LETTERS), (TERM_RUN, LETTERS_DIGITS)])
def test_terms(monkeypatch, pattern, table):
    monkeypatch.setattr("shelfwise.llm.terms.WINDOW", 7)
    text = "".join(map(chr, range(300))) + " Äpfel a1B2-c 中文,x  " + "long" * 9
    assert [t for part in terms(text.encode(), table) for t in part] == [t.encode() for t in re.findall(pattern, fold(text))]
    assert list(terms(b"", table)) == []


# Exact top-k search.


def nearest(rows, k):
    whole = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(whole):
        if q is not None and q % 50 == 0:
            scores = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), c) for n, (c, w) in enumerate(whole) if n != at]
            scores.sort(key=lambda s: (-s[0], last(s[1])))
            out += [(q, r + 1, c, s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def searched(spark, rows, k, kind="float"):
    df = frame(spark, rows, f"vec_id long, embedding array<{kind}>")
    return rows_of(vector_search.top_k(df, F.col("vec_id") % 50 == 0, k))


@pytest.mark.parametrize("dims, spread", [(3, 1), (64, 1), (40, 30), (64, 0)])
def test_top_k(spark, batches, monkeypatch, dims, spread):
    r = np.random.default_rng(dims + spread)
    centres = r.normal(size=(6, dims))
    rows = [(i * 5, (centres[i % 6] + spread * 0.2 * r.normal(size=dims)).astype("f4").tolist()) for i in range(120)]
    rows += [rows[0], rows[0], (50, rows[3][1]), (None, rows[1][1]), (7, None), (100, [None] * dims), (9, [math.nan] * dims),
             (150, [math.inf] * dims), (200, []), (11, rows[2][1] + [0.5, -3.0]), (-50, rows[4][1][:2]), (13, [0.0] * dims)]
    assert searched(spark, rows, 5) == nearest(rows, 5)


def test_top_k_small_blocks(spark):
    """Many blocks a cell: pruning by bounds, compaction, single pairs."""
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=48) * (1 + 9 * (i % 17 == 0))).tolist()) for i in range(4_500)]
    assert searched(spark, rows, 3, "double") == nearest(rows, 3)


def test_top_k_beyond_doubles(spark):
    rows = [(0, [3e38, -1.0, 0.1]), (1, [3e38, 2.5, 0.1]), (50, [-1e20, 1.0, 7.0]), (3, [1e300, 0.0, 0.0]), (4, [0.1, 1e15, 5.0])]
    assert searched(spark, rows, 5, "double") == nearest(rows, 5)


def test_top_k_few_and_none(spark):
    assert searched(spark, [(0, [1.0])], 5) == [] and searched(spark, [], 5) == []
    assert searched(spark, [(0, [1.0]), (1, [2.0])], 5) == [(0, 1, 1, 256 * 512)]
    assert searched(spark, [(1, [1.0]), (2, [2.0])], 5) == []


# Ranked lexical search.


def ranked(docs, items, k):
    split = lambda t: re.findall(TERM_RUN, fold(t or ""))
    docs = [(d, Counter(split(t))) for d, t in docs]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n, words = len(docs), sum(s for _, _, s in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, size in docs:
            m = 25 + 75 * size * n // words
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in split(text) if t in c
            )
            if score > 0:
                scores.append((-score, last(d), d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def corpus(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "中文", "Été"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(r.choices(words, weights, k=r.choice([1, 5, 40, 200])))) for i in range(n)]


@pytest.mark.parametrize("sizes", [(32, 8, 8), (2, 2, 2), (3, 1, 2)])
def test_ranked_documents(spark, batches, monkeypatch, sizes):
    for name, size in zip(("LEAF_DOCS", "LEAF_ITEMS", "FAN"), sizes):
        monkeypatch.setattr(lexical_search, name, size)
    docs = corpus(150)
    docs += [docs[0], docs[0], (None, docs[1][1]), (900, None), (901, ""), (902, " ., "), (903, docs[2][1] * 30), (904, "W1 w1")]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]
    r = random.Random(2)
    items = [(i, " ".join(r.choice(docs[:100])[1].split()[:40])) for i in range(30)]
    items += [items[0], (items[0][0], "w7 W7 w8"), (None, "w250"), (77, None), (78, ""), (79, "nowhere"), (80, "w1")]
    for ranks in (1, 10):
        got = lexical_search.ranked_documents(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string"), ranks)
        assert rows_of(got) == ranked(docs, items, ranks)


def test_ranked_documents_item_batches(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 400)
    docs, items = corpus(60), corpus(20, 5)
    got = lexical_search.ranked_documents(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string"))
    assert rows_of(got) == ranked(docs, items, 10)


def test_ranked_documents_leave_batches_out(spark):
    """Most pairs are left out unscored where a few documents stand out."""
    r = np.random.default_rng(4)
    lengths = np.full(4_000, 6)
    term = np.sort(r.integers(0, 500, (4_000, 6)) + np.arange(6) * 500, axis=1).ravel()
    value = r.integers(1, 50, len(term))
    value[: 6 * 32] += 5_000
    items = lexical_search.Items(np.repeat(np.arange(16), 6), term[: 6 * 16], np.ones(96, np.int64), 16, 3_000, 1)
    scored = lexical_search.search_tree(items, list(range(4_000)), lengths, term, value, 3_000)
    assert [best[0][2] for best in items.best] == list(range(16)) and scored < 4_000 * 16 / 10


def test_ranked_documents_empty(spark):
    none = frame(spark, [], "doc_id long, text string"), frame(spark, [], "item_id long, text string")
    some = frame(spark, [(1, "a b")], "doc_id long, text string"), frame(spark, [(1, "a")], "item_id long, text string")
    for docs in (none[0], some[0]):
        for items in (none[1], some[1]):
            found = lexical_search.ranked_documents(docs, items)
            assert found.columns == ["item_id", "rank", "doc_id", "score"]
            # A term of all documents weighs floor(1000 ln(4/3)).
            assert rows_of(found) == ranked([(1, "a b")] * (docs is some[0]), [(1, "a")] * (items is some[1]), 10)


# Divergence of sources.


def diverged(rows, least, top):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall(LETTER_RUN, fold(text or ""))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        def rate(count, total):
            return 1 + 1_000_000_000 * (count + 2) // (total + 2 * len(kept))
        def rates(c):
            total = sum(c[t] for t in kept)
            return {t: rate(c[t], total) for t in kept}
        def apart(x, y):
            return (x - y) ** 2 // (x + y)
        p = rates(groups[lang, source])
        q = rates(sum((c for (name, _), c in groups.items() if name == lang), Counter()))
        pairs = []
        for name, other in groups:
            if name == lang and other != source:
                theirs = rates(groups[name, other])
                pairs.append((-sum(apart(p[t], theirs[t]) for t in kept), other))
        words = [(-apart(p[t], q[t]), t) for t in kept if groups[lang, source][t] and p[t] > q[t]]
        for part, found, stop in (("pair", pairs, None), ("term", words, top)):
            found.sort(key=lambda f: (f[0], f[1].encode()))
            out += [(lang, source, part, item, -value, r + 1) for r, (value, item) in enumerate(found[:stop])]
    return sorted(out, key=repr)


def told(n, seed=1):
    r = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)] + ["ÉÉ", "É", "中", "\U0001f600", "A", "a"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [
        (" ".join(r.choices(words, weights, k=r.choice([0, 3, 30, 300]))), r.choice(["en", "de", None]), r.choice("abcdefgh"))
        for _ in range(n)
    ]


@pytest.mark.parametrize("dense, chunk, sources, held", [(24, 16_384, 32, 400_000), (2, 50, 3, 20), (1, 16_384, 2, 100), (10**6, 70, 32, 50)])
def test_source_divergence(spark, batches, monkeypatch, dense, chunk, sources, held):
    for name, value in (("DENSE", dense), ("CHUNK_TERMS", chunk), ("SOURCES", sources), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    rows = told(250)
    rows += [rows[0]] * 3 + [(None, "en", "i"), ("", None, None), ("wab " * 5_000, "en", "z"), ("rare", "fr", "x"), ("rarer", "fr", "y")]
    df = frame(spark, rows, "text string, lang string, source string")
    assert rows_of(divergence.source_divergence(df, 3, 4)) == diverged(rows, 3, 4)


def test_source_divergence_few_and_none(spark):
    for rows in ([], [("a a b", "en", "x")], [("a", "en", "x"), ("b", "en", "y"), (None, None, None)]):
        df = frame(spark, rows, "text string, lang string, source string")
        for least in (1, 10):
            assert rows_of(divergence.source_divergence(df, least)) == diverged(rows, least, 10)


def test_rates_beyond_32_bits():
    counts = np.array([0, 5, 2**33, 10**12])
    assert divergence.rates(counts, 2 * 10**12, 7).tolist() == [1 + 10**9 * (int(c) + 2) // (2 * 10**12 + 14) for c in counts]
