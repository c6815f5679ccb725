"""Ranked lexical search by two trees.

A document is a vector of what each term of the items would add to a score, an
item a vector of how often it holds each term. Both sides have a hierarchy whose
nodes hold the maximum of every coordinate below them, so the product of two
nodes bounds the score of every pair below. Pairs of nodes are taken by falling
bound; where the bound is under the weakest k-th score of the node's items, the
whole batch of pairs is left out. What is left out could not have entered a list.

Documents are read once for their terms, once more in the order of their
heaviest term and their length, so that nodes are of a kind. Items come in
batches of bounded text.
"""

from __future__ import annotations

import heapq
import math
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.batches import record, slices, staged, tasks, texts_of
from shelfwise.llm.terms import LETTERS_DIGITS, raw, terms

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of item text in a batch, on average; a longer item is a batch of its own.
ITEM_BYTES = 4 << 20
#: Documents and items in a leaf, children of an inner node.
LEAF_DOCS, LEAF_ITEMS, FAN = 32, 8, 8
#: Documents and entries in one tree, at most about.
TREE_DOCS, TREE_ENTRIES = 16_384, 4_000_000

_VECTORS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]
)
_LED = pa.schema([("lead", pa.int32()), *_VECTORS])
_HITS = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _lists(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values, kind))


def _vectors(shared):
    """How often a document holds each term of the items, and how many terms it has in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for part in slices(batches):
            sizes, found, counts, ends = [], [], [], []
            for data in raw(part.column("text")):
                n, tally = 0, Counter()
                for words in terms(data, LETTERS_DIGITS):
                    n += len(words)
                    tally.update(map(number.get, words))
                tally.pop(None, None)
                own = sorted(tally)
                sizes.append(n)
                found += own
                counts += [tally[t] for t in own]
                ends.append(len(found))
            yield record(
                _VECTORS, part.column("key"), np.array(sizes, np.int64),
                _lists(np.array(found, np.int32), ends, pa.int32()), _lists(np.array(counts, np.int64), ends, pa.int64()),
            )

    return run


def _gains(n: np.ndarray, lengths: np.ndarray, at: np.ndarray, often: np.ndarray, weights: np.ndarray, docs: int, words: int):
    """What each entry adds to a score for each time that an item has the term."""
    wide = int(n.max(initial=0)) * 75 * docs >= 2**63
    m = 25 + ((75 * n.astype(object) * docs) // words).astype(np.int64) if wide else 25 + 75 * n * docs // words
    return weights[at] * (1_000_000_000 * often // (1000 * often + 8 * np.repeat(m, lengths)))


def _entries(part: pa.RecordBatch):
    column = part.column("terms")
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    return part.column("n").to_numpy(), lengths, column.flatten().to_numpy(), part.column("counts").flatten().to_numpy()


def _lead(shared, docs: int, words: int):
    """Adds the heaviest term of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value["weights"]
        for part in batches:
            if not part.num_rows:
                continue
            n, lengths, at, often = _entries(part)
            gains = _gains(n, lengths, at, often, weights, docs, words)
            starts = np.cumsum(lengths) - lengths
            most = np.maximum.reduceat(gains, starts)
            places = np.where(gains == np.repeat(most, lengths), at, np.iinfo(np.int32).max)
            yield record(_LED, np.minimum.reduceat(places, starts), *part.columns)

    return run


class Level:
    """Nodes of one height: sorted (node, term) keys with the largest value of the term below the node."""

    def __init__(self, node: np.ndarray, term: np.ndarray, value: np.ndarray, width: int):
        self.width = width
        keys = node.astype(np.int64) * width + term
        order = np.argsort(keys, kind="stable")
        keys, value = keys[order], value[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.values = keys[starts], np.maximum.reduceat(value, starts) if len(keys) else value
        self.nodes = int(node.max(initial=-1)) + 1

    def above(self) -> Level:
        return Level(self.keys // self.width // FAN, self.keys % self.width, self.values, self.width)

    def node(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.keys, (i * self.width, (i + 1) * self.width))
        return self.keys[a:b] - i * self.width, self.values[a:b]

    def bounds(self, nodes: np.ndarray, term: np.ndarray, often: np.ndarray) -> np.ndarray:
        """The largest possible sum of ``often`` times the values of ``term``, for each of ``nodes``."""
        wanted = nodes[:, None] * self.width + term
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (np.where(self.keys[at] == wanted, self.values[at], 0) * often).sum(1)


def levels(owner: np.ndarray, term: np.ndarray, value: np.ndarray, width: int, leaf: int) -> list[Level]:
    """From the leaves up to the root."""
    out = [Level(owner // leaf, term, value, width)]
    while out[-1].nodes > 1:
        out.append(out[-1].above())
    return out


class Items:
    """The items of a batch as a tree; they stand in the order of their rarest term."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, often: np.ndarray, count: int, width: int, k: int):
        self.k, self.count = k, count
        self.levels = levels(owner, term, often, width, LEAF_ITEMS)
        self.nodes = [[level.node(i) for i in range(level.nodes)] for level in self.levels]
        # A leaf as a table: a row per item, a column per term of the leaf.
        self.tables = []
        for leaf, (own, _) in enumerate(self.nodes[0]):
            table = np.zeros((min(LEAF_ITEMS, count - leaf * LEAF_ITEMS), len(own)), np.int64)
            mine = owner // LEAF_ITEMS == leaf
            table[owner[mine] - leaf * LEAF_ITEMS, np.searchsorted(own, term[mine])] = often[mine]
            self.tables.append(table)
        self.best: list[list[tuple]] = [[] for _ in range(count)]
        #: Scores from which a document enters a list; the k-th score, at first anything above 0.
        self.worst = np.ones(count, np.int64)

    def span(self, height: int, node: int) -> slice:
        wide = LEAF_ITEMS * FAN**height
        return slice(node * wide, (node + 1) * wide)

    def offer(self, item: int, scores: np.ndarray, ids: list) -> None:
        """Puts documents into an item's list: by score, then id, null ids last."""
        rows = [(-int(s), d is None, d or 0) for s, d in zip(scores, ids)]
        best = heapq.nsmallest(self.k, [*self.best[item], *rows])
        self.best[item] = best
        if len(best) == self.k:
            self.worst[item] = max(1, -best[-1][0])


def search_tree(items: Items, ids: list, lengths: np.ndarray, term: np.ndarray, value: np.ndarray, width: int) -> int:
    """Takes the documents of one tree into the lists of the items. Returns how many pairs were scored."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    docs = levels(owner, term, value, width, LEAF_DOCS)
    starts = np.r_[0, np.cumsum(lengths)]
    scored = 0

    def score(leaf: int, batch: int) -> int:
        first, last = batch * LEAF_DOCS, min((batch + 1) * LEAF_DOCS, len(lengths))
        a, b = starts[first], starts[last]
        own, table = items.nodes[0][leaf][0], items.tables[leaf]
        at = np.minimum(np.searchsorted(own, term[a:b]), len(own) - 1)
        (hit,) = np.nonzero(own[at] == term[a:b])
        if not len(hit):
            return 0
        who = owner[a:b][hit]
        cuts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        sums = np.add.reduceat(table[:, at[hit]] * value[a:b][hit], cuts, axis=1)
        span = items.span(0, leaf)
        enters = sums >= items.worst[span][:, None]
        for row in np.flatnonzero(enters.any(1)).tolist():
            (columns,) = np.nonzero(enters[row])
            items.offer(span.start + row, sums[row, columns], [ids[d] for d in who[cuts[columns]].tolist()])
        return sums.size

    def children(heights: tuple[int, int], item: int, batches: np.ndarray):
        own, often = items.nodes[heights[0]][item]
        if not len(own):
            return
        weakest = items.worst[items.span(heights[0], item)].min()
        for bound, batch in zip(docs[heights[1]].bounds(batches, own, often).tolist(), batches.tolist()):
            if bound >= weakest:
                heapq.heappush(queue, (-bound, heights, item, batch))

    queue: list[tuple] = []
    children((len(items.levels) - 1, len(docs) - 1), 0, np.zeros(1, np.int64))
    while queue:
        bound, (up, high), item, batch = heapq.heappop(queue)
        if -bound < items.worst[items.span(up, item)].min():
            continue
        if high:  # the documents' node first: its children are looked up together
            below = np.arange(batch * FAN, min((batch + 1) * FAN, docs[high - 1].nodes))
            children((up, high - 1), item, below)
        elif up:
            for child in range(item * FAN, min((item + 1) * FAN, items.levels[up - 1].nodes)):
                children((up - 1, 0), child, np.array([batch]))
        else:
            scored += score(item, batch)
    return scored


def _search(shared, docs: int, words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        width = len(given["weights"])
        items = Items(given["owner"], given["term"], given["often"], given["count"], width, k)
        held: list[tuple] = []

        def grow():
            ids = [d for x in held for d in x[0]]
            search_tree(items, ids, *(np.concatenate([x[i] for x in held]) for i in (1, 2, 3)), width)
            held.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, TREE_DOCS):
                part = batch.slice(start, TREE_DOCS)
                n, lengths, at, often = _entries(part)
                gains = _gains(n, lengths, at, often, given["weights"], docs, words)
                held.append((part.column("doc_id").to_pylist(), lengths, at.astype(np.int64), gains))
                if sum(len(x[0]) for x in held) >= TREE_DOCS or sum(len(x[2]) for x in held) >= TREE_ENTRIES:
                    grow()
        if held:
            grow()
        rows = [(i, None if d[1] else d[2], -d[0]) for i, best in enumerate(items.best) for d in best]
        if rows:
            yield record(_HITS, *zip(*rows))

    return run


def _batch(rows: list) -> tuple[list, dict, list[Counter]]:
    """Items with terms, the number of each term, the terms of each item."""
    found = []
    for r in rows:
        tally: Counter = Counter()
        for words in terms((r["text"] or "").encode(), LETTERS_DIGITS):
            tally.update(words)
        if tally:
            found.append((r, tally))
    number = {t: i for i, t in enumerate(sorted({t for _, tally in found for t in tally}))}
    return [r for r, _ in found], number, [tally for _, tally in found]


def ranked_documents(
    df: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, of those with a score above 0.

    Terms are runs of letters, digits and characters beyond ASCII, with A-Z
    lower-cased. ``n`` terms of a document, ``N`` documents with terms, ``L``
    terms in all of them, ``df`` documents that hold a term and ``tf`` times in
    one give the weight ``floor(1000 ln((2N+2)/(2df+1)))`` and the gain
    ``weight * (10^9 tf div (1000 tf + 8 (25 + 75 n N div L)))``, summed over the
    terms of the item with repeats. Equal scores go by id, a null id last.

    Every row of both tables counts on its own: repeated documents each take a
    rank, and repeated items each have a list. Null and empty texts have no
    terms: such documents are in no list, such items have none. Empty tables
    give no rows, further columns are ignored. Texts are read whole.
    """
    spark = df.sparkSession
    rows = items.select(items[item_col].cast("long").alias("item_id"), items[item_text_col].cast("string").alias("text"))
    rows = rows.where("text IS NOT NULL").groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // ITEM_BYTES))
    lists = []
    for part in range(parts):
        # A batch of bounded text, whatever the number of items.
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        held, number, tallies = _batch(mine)
        if not held:
            continue
        shared = spark.sparkContext.broadcast(number)
        vectors = staged(
            texts_of(df, id_col, text_col).mapInArrow(
                _vectors(shared), "doc_id long, n long, terms array<int>, counts array<long>"
            ),
            "vectors",
        )
        docs, words = vectors.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not docs:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        frequency = np.zeros(len(number), object)
        # One row for each term of the batch.
        for term, count in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            frequency[term] = count
        weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * f + 1))) for f in frequency], np.int64)
        # Items of a kind stand together: by their heaviest term.
        entries = [sorted((number[t], c) for t, c in tally.items()) for tally in tallies]
        order = sorted(range(len(held)), key=lambda i: (max((weights[t], t) for t, _ in entries[i]), i))
        held, entries = [held[i] for i in order], [entries[i] for i in order]
        flat = [(i, t, c) for i, own in enumerate(entries) for t, c in own]
        owner, term, often = (np.array(x, np.int64) for x in zip(*flat))
        given = spark.sparkContext.broadcast(
            {"weights": weights, "owner": owner, "term": term, "often": often, "count": len(held)}
        )
        hits = (
            vectors.where(F.size("terms") > 0)
            .mapInArrow(_lead(given, docs, words), "lead int, doc_id long, n long, terms array<int>, counts array<long>")
            .repartitionByRange(tasks(df), "lead", "n", "doc_id")
            .sortWithinPartitions("lead", "n", "doc_id")
            .mapInArrow(_search(given, docs, words, k), "item int, doc_id long, score long")
        )
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame(
            [(i, r["item_id"], r["copies"]) for i, r in enumerate(held)], "item int, item_id long, copies long"
        )
        lists.append(
            ranked.join(names, "item")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .select("item_id", "rank", "doc_id", "score")
        )
    if not lists:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out
