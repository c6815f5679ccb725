"""Benchmark decontamination: SimHash of item-sized windows, confirmed exactly.

For each item, every window of as many words as the item has is compared with
it. A window's fingerprint is the SimHash of its word shingles, from running
sums over the words. Fingerprints are cut into blocks: if two of them differ in
at most ``RADIUS`` bits, some block differs in at most ``RADIUS // BLOCKS``, so
a table from block values to items finds every item within the radius. Those
are confirmed by the exact weighted similarity of the shingles.

Two sets of N shingles at similarity s share 2 s N / (1 + s). Windows with fewer
shingles of any item cannot match and get no fingerprint; nothing is lost.
Where a shingle repeats in a window or an item, one vote sets many bits; those
are compared by a lookup of all their shingles, without fingerprints. For other
pairs of exactly 0.75 the radius has a small miss rate, given in the README.

The whole text is a window too, whatever its size, so that copies with words
left out or put in are found where they are all of a document. Two sets of M and
N shingles at similarity s share at least s M of M: the few texts of which so
many shingles are an item's are compared by that lookup too.

Items come in parts of bounded size, each broadcast with its tables; a text is
compared with all parts in one pass over the documents.
"""

from __future__ import annotations

import math
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.batches import Shared, bytes_of, offsets_of, slices
from shelfwise.llm.chosen_path import lowered
from shelfwise.llm.rolling import Hashes, mix, split_words, word_symbols

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RADIUS, BLOCKS = 23, 8
#: Items and bytes of text in one part.
PART_ITEMS, PART_BYTES = 2_048, 4 << 20

_U = np.uint64


def _bits(values: np.ndarray) -> np.ndarray:
    """One column per bit, as -1 and 1."""
    raw = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return raw.astype(np.int32) * 2 - 1


def fingerprints(votes: np.ndarray) -> np.ndarray:
    """SimHash from the summed votes of each bit; a tie is 0."""
    return np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def weighted_similarity(a: Counter, b: Counter) -> float:
    common = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return common / (a.total() + b.total() - common)


class Group:
    """Items of one size in words: their shingles, fingerprints and block tables."""

    def __init__(self, size: int, length: int, items: list[tuple[int, np.ndarray]]):
        self.size, self.length = size, length
        self.ids = [i for i, _ in items]
        self.weights = [Counter(s.tolist()) for _, s in items]
        self.repeats = any(len(w) < w.total() for w in self.weights)
        self.prints = fingerprints(np.array([_bits(s).sum(axis=0) for _, s in items]))
        values = np.arange(256, dtype=np.uint8)
        blocks = self.prints.view(np.uint8).reshape(-1, 8)
        distance = np.bitwise_count(values[:, None, None] ^ blocks.T[None])  # value, block, item
        self.near = np.ascontiguousarray((distance <= RADIUS // BLOCKS).transpose(1, 0, 2))

    def candidates(self, prints: np.ndarray):
        """(window, item) of all fingerprints within the radius."""
        blocks = prints.view(np.uint8).reshape(-1, 8)
        met = self.near[0][blocks[:, 0]]
        for b in range(1, BLOCKS):
            met |= self.near[b][blocks[:, b]]
        window, item = np.nonzero(met)
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[close], item[close]


class Postings:
    """The items that hold each shingle of one length, and how often."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.totals = np.array([len(s) for _, s in items])
        counted = [np.unique(s, return_counts=True) for _, s in items]
        shingles = np.concatenate([s for s, _ in counted])
        order = np.argsort(shingles, kind="stable")
        self.shingles = shingles[order]
        self.item = np.repeat(np.arange(len(items)), [len(s) for s, _ in counted])[order]
        self.weight = np.concatenate([n for _, n in counted])[order]

    def similarities(self, shingles: np.ndarray) -> np.ndarray:
        """Exact weighted similarity of one window to every item."""
        own, weight = np.unique(shingles, return_counts=True)
        low, high = (np.searchsorted(self.shingles, own, side) for side in ("left", "right"))
        count = high - low
        at = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        shared = np.minimum(np.repeat(weight, count), self.weight[at])
        common = np.bincount(self.item[at], shared, len(self.ids))
        return common / (len(shingles) + self.totals - common)


class Part:
    """A bounded part of the benchmark, prepared for lookups."""

    def __init__(self, items: list[tuple[int, str]], words: int, similarity: float):
        self.similarity = similarity
        by_size = defaultdict(list)
        shingles = defaultdict(list)
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            data, offsets = lowered(raw), np.array([0, len(raw)])
            starts, ends, _ = split_words(data, offsets)
            if not len(starts):
                continue
            length = min(words, len(starts))
            own = Hashes.of_words(word_symbols(data, starts, ends)).fixed(length)
            by_size[len(starts), length].append((item, own))
            shingles[length].append((item, own))
        self.groups = [Group(size, length, items) for (size, length), items in sorted(by_size.items())]
        self.postings = {length: Postings(s) for length, s in shingles.items()}
        self.known = {length: np.unique(p.shingles) for length, p in self.postings.items()}
        self.maybe = {}
        for length, known in self.known.items():
            self.maybe[length] = np.zeros(1 << 20, bool)
            self.maybe[length][known >> _U(44)] = True

    def _hits(self, shingles: np.ndarray, length: int) -> np.ndarray:
        hit = self.maybe[length][shingles >> _U(44)]
        at = np.flatnonzero(hit)
        known = self.known[length]
        place = np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)
        hit[at] = known[place] == shingles[at]
        return hit

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float]]:
        """(text, item, similarity) of windows at or above the threshold."""
        data = lowered(data)
        starts, ends, first = split_words(data, offsets)
        hashes = Hashes.of_words(word_symbols(data, starts, ends))
        by_length = {}
        for length in self.known:
            shingles = hashes.fixed(length)
            hit = self._hits(shingles, length) if len(shingles) else np.zeros(0, bool)
            by_length[length] = shingles, np.r_[0, np.cumsum(hit)]
        out: dict[tuple[int, int], float] = {}
        for length, (shingles, hits) in by_length.items():
            self._whole(self.postings[length], shingles, hits, first, length, out)
        for group in self.groups:
            shingles, hits = by_length[group.length]
            n = group.size - group.length + 1  # shingles of a window
            if len(shingles) < n or hits[-1] == 0:
                continue
            need = math.ceil(2 * self.similarity / (1 + self.similarity) * n - 1e-9)
            start = np.flatnonzero(hits[n:] - hits[:-n] >= need)
            doc = np.searchsorted(first, start, side="right") - 1
            inside = start + group.size <= first[doc + 1]
            start, doc = start[inside], doc[inside]
            for a in range(0, len(start), 2_000):
                self._repeats(group, shingles, n, start[a : a + 2_000], doc[a : a + 2_000], out)
                self._windows(group, shingles, n, start[a : a + 2_000], doc[a : a + 2_000], out)
        return [(d, i, s) for (d, i), s in out.items()]

    def _whole(self, postings: Postings, shingles, hits, first, length, out) -> None:
        begin = first[:-1]
        end = np.maximum(begin, first[1:] - length + 1)  # of the shingles that lie in the text
        some = np.flatnonzero(end > begin)
        known = hits[end[some]] - hits[begin[some]]
        need = np.ceil(self.similarity * (end - begin)[some] - 1e-9)
        for d in some[known >= need].tolist():
            similarity = postings.similarities(shingles[begin[d] : end[d]])
            for i in np.flatnonzero(similarity >= self.similarity).tolist():
                key = d, postings.ids[i]
                out[key] = max(out.get(key, 0.0), float(similarity[i]))

    def _repeats(self, group: Group, shingles, n, start, doc, out) -> None:
        """Windows in which a shingle repeats, or all for items in which one does: exactly, without fingerprints."""
        cover = np.unique(start[:, None] + np.arange(n))
        low, own = np.searchsorted(cover, start), shingles[cover]
        order = np.argsort(own, kind="stable")
        again = np.full(len(own), len(own))  # the next place of the same shingle
        same = own[order[1:]] == own[order[:-1]]
        again[order[:-1][same]] = order[1:][same]
        soonest = np.minimum.accumulate(again[::-1])[::-1]
        take = np.flatnonzero((soonest[low] < low + n) | group.repeats)
        sums = np.r_[_U(0), np.cumsum(mix(own))]
        bags = sums[low[take] + n] - sums[low[take]]  # alike for the same shingles in any order
        _, first, bag = np.unique(bags, return_index=True, return_inverse=True)
        postings = self.postings[group.length]
        found = []
        for w in take[first].tolist():
            similarity = postings.similarities(shingles[start[w] : start[w] + n])
            fit = np.flatnonzero((similarity >= self.similarity) & (postings.totals == n))
            found.append([(postings.ids[i], float(similarity[i])) for i in fit])
        for d, b in np.unique(np.column_stack([doc[take], bag]), axis=0).tolist():
            for i, similarity in found[b]:
                out[d, i] = max(out.get((d, i), 0.0), similarity)

    def _windows(self, group: Group, shingles, n, start, doc, out) -> None:
        # Running votes over the words that the windows cover, and no others.
        cover = np.unique(start[:, None] + np.arange(n))
        running = np.zeros((len(cover) + 1, 64), np.int32)
        np.cumsum(_bits(shingles[cover]), axis=0, out=running[1:])
        low = np.searchsorted(cover, start)
        window, item = group.candidates(fingerprints(running[low + n] - running[low]))
        weights: dict[int, Counter] = {}
        for w, i in zip(window.tolist(), item.tolist()):
            if w not in weights:
                weights[w] = Counter(shingles[start[w] : start[w] + n].tolist())
            similarity = weighted_similarity(weights[w], group.weights[i])
            if similarity >= self.similarity:
                key = int(doc[w]), group.ids[i]
                out[key] = max(out.get(key, 0.0), similarity)


_MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64())]))


def benchmark_matches(
    text: Column, benchmark: DataFrame, words: int = 5, similarity: float = 0.75,
    item_col: str = "item_id", item_text_col: str = "text",
) -> Column:
    """array of (item_id, similarity) for a text column: the items it holds a near copy of.

    Null text and null items match nothing; a null item id is reported as -1.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.coalesce(benchmark[item_col].cast("long"), F.lit(-1)).alias("item"),
        benchmark[item_text_col].cast("string").alias("text"),
    ).where("text IS NOT NULL")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    parts = max(1, math.ceil(size["n"] / PART_ITEMS), math.ceil(size["b"] / PART_BYTES))
    found = []
    for p in range(parts):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p).collect()
        found.append(_finder(Shared(spark, Part([(r[0], r[1]) for r in own], words, similarity)))(text))
    return F.concat(*found) if parts > 1 else found[0]


def _finder(shared):
    @F.arrow_udf("array<struct<item_id: long, similarity: double>>")
    def find(texts: pa.Array) -> pa.Array:
        part, start, rows = shared.value, 0, [[] for _ in range(len(texts))]
        batch = pa.RecordBatch.from_arrays([texts.fill_null("")], names=["text"])
        for piece in slices(iter([batch]), limit=1 << 20):
            column = piece.column("text")
            for doc, item, similarity in part.matches(bytes_of(column), offsets_of(column)):
                rows[start + doc].append({"item_id": item, "similarity": similarity})
            start += piece.num_rows
        for row in rows:
            row.sort(key=lambda m: m["item_id"])
        return pa.array(rows, _MATCHES)

    return find


def contamination(
    df: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.75,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, contaminated, item_ids, best_similarity: one row per row of ``df``.

    A document is contaminated if some window of an item's size in words, or the
    whole document, has a weighted shingle similarity of at least ``similarity``
    to it. A copy inside a longer document is measured by windows of the item's
    size only, so words put in or left out there lower its score. Shingles are
    of ``words`` words, A-Z folded; an item of fewer words is one shingle and
    matches only as it stands. Null text holds nothing; an empty benchmark
    leaves all clean; repeated rows count each, a null id stays null, an empty
    table gives no rows, further columns are ignored.
    """
    found = df.select(
        df[id_col].cast("long").alias("doc_id"),
        benchmark_matches(df[text_col].cast("string"), benchmark, words, similarity).alias("found"),
    )
    return found.select(
        "doc_id",
        (F.size("found") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.col("found.item_id"))).alias("item_ids"),
        F.coalesce(F.array_max("found.similarity"), F.lit(0.0)).alias("best_similarity"),
    )
