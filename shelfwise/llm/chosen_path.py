"""Near-duplicates by a chosen-path similarity join.

A document is a set of word shingles. Minwise values of the set, one for each
of ``COORDINATES`` hash functions, choose its paths: a node of a tree picks a
few functions by its own name, and the document goes to one child for each of
them, named by the value. Two documents of similarity J take the same child of
a function with probability J. With ``BRANCH`` functions a node, the paths of a
similar pair stay together with a probability that does not fall with depth,
and more trees raise it to the target recall. All trees share the functions, so
their number is worked out over how many of these a pair agrees in.

Nodes are compared in place: rows meet there, pairs are never rows. First with
sketches, the least shingle of each of ``BINS`` ranges of the hash, one byte
each, which only say what rows of the node may be similar to a row of another
component. Those alone come again with their full sets, and links are decided on
these; once two components have a link, their rows are not compared any more. A
pair that meets in several nodes is compared in the first one.

A first round over a few trees joins most copies. After it, only nodes that hold
several components count. Nodes that are too large to compare branch again; what
stays together at the last level is mostly one component, whose rows are dealt
to blocks, one place each, and met there by the few rows that do not belong to it.
Rows of equal sets are one vertex throughout.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.batches import bytes_of, discard, offsets_of, slices, staged, tasks
from shelfwise.llm.components import components
from shelfwise.llm.repeats import NULL_ID, documents
from shelfwise.llm.rolling import Hashes, mix, split_words, word_symbols

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COORDINATES = 128
BRANCH = 2
#: Ranges of the hash in a sketch.
BINS = 256
#: Documents in a node that are compared with each other unless connected.
SMALL_NODE = 2_048
#: Functions of the first round.
FIRST = 4
#: Functions that a pair can be found to have met in, at most.
HEADS = 62
#: Depth after which a large node is compared in blocks instead of branching.
DEPTH = 4
#: Sets that are compared with one at once.
TOGETHER = 64
#: Bits of the map that tells which texts are not asked for; 4 MB.
ASKED_BITS = 1 << 25

_U = np.uint64
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_ODD = mix(_SEEDS) | _U(1)

_PROFILE_DDL = "key long, mark long, n long, s1 long, s2 long, mins array<int>, sketch binary"


def lowered(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + upper.astype(np.uint8) * np.uint8(32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle names of each text, A-Z folded; a shorter text is one shingle."""
    data = lowered(data)
    starts, ends, first = split_words(data, offsets)
    hashes = Hashes.of_words(word_symbols(data, starts, ends))
    shingles = hashes.fixed(words)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(shingles[a : b - words + 1]))
        elif b > a:
            out.append(hashes.ranges(np.array([a]), np.array([b])))
        else:
            out.append(shingles[:0])
    return out


def _profile(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 20):
            sets = shingle_sets(bytes_of(part.column("text")), offsets_of(part.column("text")), words)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            full = np.flatnonzero(sizes)
            mins = np.zeros((len(sets), COORDINATES), np.int32)
            sums = np.zeros((2, len(sets)), np.uint64)
            sketch = np.zeros((len(sets), BINS), np.uint8)  # 0 where a range is empty
            if len(full):
                flat = np.concatenate(sets)
                at = np.r_[0, np.cumsum(sizes[full])[:-1]]
                for c in range(COORDINATES):
                    value = ((flat ^ _SEEDS[c]) * _ODD[c] >> _U(32)).astype(np.uint32)
                    mins[full, c] = np.minimum.reduceat(value, at).view(np.int32)
                doc, bin_ = np.repeat(np.arange(len(sets)), sizes), (flat >> _U(56)).astype(np.int64)
                least = np.r_[True, (bin_[1:] != bin_[:-1]) | (doc[1:] != doc[:-1])]  # sets are sorted
                sketch[doc[least], bin_[least]] = 1 + mix(flat[least]) % _U(255)
                sums[0, full] = np.add.reduceat(mix(flat), at)
                sums[1, full] = np.add.reduceat(mix(flat ^ _U(0xA5A5A5A5A5A5A5A5)), at)
            ends = np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("mark"), pa.array(sizes), pa.array(sums[0].view(np.int64)),
                 pa.array(sums[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(mins.ravel())),
                 pa.array([x.tobytes() for x in sketch], pa.binary())],
                names=["key", "mark", "n", "s1", "s2", "mins", "sketch"],
            )

    return run


def trees_for(recall: float, similarity: float) -> int:
    """Trees of independent functions until a pair at the threshold is missed with at most 1 - recall.

    A pair's common paths are a branching process with BRANCH children, each
    kept with the probability ``similarity``; the fixed point of its generating
    function is the chance to die out in one tree, at any depth.
    """
    if BRANCH * similarity <= 1:
        raise ValueError("similarity is too low for this branching")
    lost = 0.0
    for _ in range(10_000):
        lost = (1 - similarity + similarity * lost) ** BRANCH
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def trees_sharing(recall: float, similarity: float) -> int:
    """As ``trees_for``, for trees that share the coordinates.

    The pair agrees in a binomial number of them, and that share is the chance
    of a common child in every tree.
    """
    agree = np.arange(COORDINATES + 1)
    kept = agree / COORDINATES
    odds = np.array([math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) for k in agree])
    lost = np.zeros(COORDINATES + 1)
    for _ in range(10_000):
        lost = (1 - kept + kept * lost) ** BRANCH
    for trees in range(trees_for(recall, similarity), COORDINATES // BRANCH + 1):
        if (odds * lost**trees).sum() <= 1 - recall:
            return trees
    raise ValueError("too few coordinates for this recall")


def least_agreement(similarity: float, miss: float) -> np.ndarray:
    """For u ranges that hold something in either sketch, the agreeing ranges to ask for.

    Ranges are drawn without replacement, so they agree at least as evenly as
    ``u`` coins of probability ``similarity`` fall: a pair at the threshold has
    fewer with probability ``miss`` at most.
    """
    need = np.zeros(BINS + 1, np.int64)
    for u in range(1, BINS + 1):
        total, k = 0.0, 0
        while total <= miss:
            total += math.comb(u, k) * similarity**k * (1 - similarity) ** (u - k)
            k += 1
        need[u] = k - 1
    return need


def _children(parent: str) -> str:
    """SQL for the child names of a document at a node: BRANCH different coordinates."""
    first = f"int(pmod(xxhash64({parent}, 1), {COORDINATES}))"
    step = f"int(1 + pmod(xxhash64({parent}, 2), {COORDINATES - 1}))"
    places = [f"int(pmod({first} + {i} * {step}, {COORDINATES}))" for i in range(BRANCH)]
    return "array(" + ", ".join(f"xxhash64({parent}, {p}, mins[{p}])" for p in places) + ")"


class _Node:
    """The rows of a node, as arrays."""

    def __init__(self, columns: dict, percent: int, need: np.ndarray):
        self.rep, self.root, self.side, self.n = (columns[k] for k in ("rep", "root", "side", "n"))
        self.sketch, self.heads, self.sets = columns["sketch"], columns["heads"], columns.get("shingles")
        self.percent, self.need = percent, need
        # Functions before this node's, in nodes that were or will be compared whole.
        before = np.arange(self.heads.shape[1]) < columns["pick"][:, None]
        self.met = before & ((columns["whole"][:, None] >> np.arange(self.heads.shape[1])) & 1).astype(bool)

    def candidates(self, i: int, label: np.ndarray) -> np.ndarray:
        """Later rows that may be similar to row i, are of another label and have not met it before."""
        j = np.arange(i + 1, len(self.rep))
        n, own = self.n[j], self.n[i]
        j = j[(label[j] != label[i]) & ((self.side[j] != self.side[i]) | (self.side[j] == 2))
              & (100 * np.minimum(n, own) >= self.percent * np.maximum(n, own))]
        if not len(j):
            return j
        j = j[~((self.heads[j] == self.heads[i]) & self.met[i]).any(axis=1)]
        a, b = self.sketch[i], self.sketch[j]
        filled = (a | b) != 0
        return j[np.count_nonzero((a == b) & filled, axis=1) >= self.need[np.count_nonzero(filled, axis=1)]]

    def open_rows(self) -> np.ndarray:
        """Which rows have a candidate."""
        found = np.zeros(len(self.rep), bool)
        for i in range(len(self.rep) - 1):
            j = self.candidates(i, self.root)
            if len(j):
                found[i] = found[j] = True
        return found

    def links(self) -> list[tuple[int, int]]:
        """Similar pairs (row, row) that join components, as few as connect them."""
        label, out = self.root.copy(), []
        for i in range(len(self.rep) - 1):
            j = self.candidates(i, label)
            while len(j):
                part, j = j[:TOGETHER], j[TOGETHER:]
                for x in part[similar_to(self.sets[i], [self.sets[x] for x in part], self.percent)].tolist():
                    if label[x] != label[i]:
                        out.append((i, x))
                        label[label == label[x]] = label[i]
                j = j[label[j] != label[i]]
        return out


def similar_to(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sorted sets share ``percent`` hundredths of their union with this one."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    flat = np.concatenate(others)
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * common >= percent * (sizes + len(own) - common)


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole nodes, of rows sorted by node; the last node of a batch waits for the next one."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column("node").to_numpy()
        cut = int(np.searchsorted(node, node[-1]))
        if cut or rest and rest[-1].column("node")[-1].as_py() != node[0]:
            (whole,) = pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks().to_batches()
            yield whole
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        (whole,) = pa.Table.from_batches(rest).combine_chunks().to_batches()
        yield whole


def _by_node(percent: int, need: np.ndarray, decide: bool):
    """Rows sorted by node: those with candidates, or with their sets, the links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_nodes(batches):
            node = batch.column("node").to_numpy()
            columns = {n: batch.column(n).to_numpy() for n in ("rep", "root", "side", "n", "pick", "whole")}
            columns["sketch"] = bytes_of(batch.column("sketch")).reshape(-1, BINS)
            columns["heads"] = batch.column("heads").flatten().to_numpy().reshape(len(node), -1)
            if decide:
                data, ends = bytes_of(batch.column("shingles")), offsets_of(batch.column("shingles"))
            cuts = np.r_[np.flatnonzero(np.r_[True, node[1:] != node[:-1]]), len(node)]
            keep, pairs = np.zeros(len(node), bool), []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a < 2:
                    continue
                own = {n: c[a:b] for n, c in columns.items()}
                if decide:
                    own["shingles"] = [data[x:y].view(np.uint64) for x, y in zip(ends[a:b].tolist(), ends[a + 1 : b + 1].tolist())]
                    pairs += [(own["rep"][i], own["rep"][j]) for i, j in _Node(own, percent, need).links()]
                else:
                    keep[a:b] = _Node(own, percent, need).open_rows()
            if decide:
                found = np.array(pairs, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])
            else:
                yield batch.filter(pa.array(keep))

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 20):
            sets = shingle_sets(bytes_of(part.column("text")), offsets_of(part.column("text")), words)
            yield pa.RecordBatch.from_arrays(
                [part.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "shingles"]
            )

    return run


def _maybe_asked(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (key, mark) is in ``asked``, and a few others that share a bit with one.

    The bits are built by a shuffle and broadcast at the same bounded size for
    tables of any size, so texts that are not asked for are never sent.
    """
    place = F.pmod(F.xxhash64("key", "mark"), F.lit(ASKED_BITS))
    bits = (
        asked.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    )
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = docs.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "bucket")
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("bucket", "bits")


def near_duplicates(
    df: DataFrame, percent: int = 75, words: int = 5, recall: float = 0.999999,
    id_col: str = "doc_id", text_col: str = "text", marks: bool = False,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``df``.

    Links documents whose sets of ``words``-word shingles have an intersection
    of at least ``percent`` hundredths of their union, and gives the smallest id
    reachable over links. Each link is confirmed on the full sets; a pair of
    exactly that similarity is met by the search with probability ``recall`` at
    least, a more similar one with more. Null or blank text has an empty set and
    is linked with nothing; a text of fewer words is one shingle. Rows of equal
    id are linked like others and one of them is kept; a null id is smaller than any and stays null, an
    empty table gives no rows, further columns are ignored. ``marks`` adds a hash of
    the text, which tells rows of one id apart.
    """
    spark, parts, own = df.sparkSession, tasks(df), []
    docs = documents(df, id_col, text_col)
    share = percent / 100
    trees, need = trees_sharing(recall, share), least_agreement(share, (1 - recall) / 10)
    wide: list[str] = []
    everything = staged(
        docs.mapInArrow(_profile(words), _PROFILE_DDL).withColumn("row", F.monotonically_increasing_id()), "profiles", wide
    )
    # One vertex per distinct set; which row stands for it only has to be fixed.
    reps = staged(
        everything.where("n > 0").groupBy("s1", "s2", "n")
        .agg(F.min(F.struct("row", "key", "mark", "mins", "sketch")).alias("r"), F.min(F.struct("key", "row")).alias("first"))
        .select(F.col("r.row").alias("rep"), "s1", "s2", "n", "first", "r.key", "r.mark", "r.mins", "r.sketch"),
        "vertices", own,
    )
    profile = staged(everything.drop("mins", "sketch"), "rows", own)
    discard(spark, wide)
    # The roots take different functions, so that no two trees start alike.
    picks = min(COORDINATES, BRANCH * trees)
    heads = min(picks, HEADS)
    start = F.expr("array(" + ", ".join(f"xxhash64({p // BRANCH}L, {p}, mins[{p}])" for p in range(picks)) + ")")
    rows = reps.select("rep", F.posexplode(start).alias("pick", "node"))
    sizes = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    placed = staged(rows.join(sizes, "node"), "nodes", own)
    # In which functions a vertex has a node that is compared whole.
    whole = placed.where(f"size <= {SMALL_NODE} AND pick < {heads}").groupBy("rep").agg(F.expr("bit_or(1L << pick)").alias("whole"))
    vertices = staged(
        reps.join(whole, "rep", "left")
        .select("rep", "n", "sketch", F.slice("mins", 1, heads).alias("heads"), F.coalesce("whole", F.lit(0).cast("long")).alias("whole")),
        "sketches", own,
    )

    def sets_of(some: DataFrame, temporary: list[str]) -> DataFrame:
        """(rep, shingles) of some vertices, from their texts."""
        asked = staged(reps.select("rep", "key", "mark").join(some, "rep", "left_semi"), "asked", temporary)
        texts = _maybe_asked(docs, asked).join(asked, ["key", "mark"]).dropDuplicates(["rep"])
        return staged(texts.select("rep", "text").mapInArrow(_sets(words), "rep long, shingles binary"), "sets", temporary)

    def sorted_by_node(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "node").sortWithinPartitions("node")

    def linked(forest, rows: DataFrame):
        """The forest with the links among rows (node, rep, root, side, pick)."""
        temporary: list[str] = []
        names, kind = ("node", "rep", "root", "side", "pick", "n", "sketch", "heads", "whole"), (
            "node long, rep long, root long, side int, pick int, n long, sketch binary, heads array<int>, whole long"
        )
        met = rows.join(vertices, "rep").select(*names)
        some = staged(sorted_by_node(met).mapInArrow(_by_node(percent, need, False), kind), "open", temporary)
        if not some.isEmpty():
            sets = sets_of(some.select("rep").distinct(), temporary)
            links = staged(
                sorted_by_node(some.join(sets, "rep")).mapInArrow(_by_node(percent, need, True), "a long, b long"), "links", temporary
            )
            if not links.isEmpty():  # else the forest stays as it is
                edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
                if forest is not None:
                    edges = edges.unionByName(forest.select(F.col("vertex").alias("u"), F.col("root").alias("v")))
                forest = components(edges, own)
        discard(spark, temporary)
        return forest

    def rooted(rows: DataFrame, forest) -> DataFrame:
        if forest is None:
            return rows.withColumn("root", F.col("rep"))
        tree = forest.select(F.col("vertex").alias("rep"), "root")
        return rows.join(tree, "rep", "left").withColumn("root", F.coalesce("root", "rep"))

    def several(rows: DataFrame, forest) -> DataFrame:
        """Rows with their root, of nodes that hold more than one."""
        rows = rooted(rows, forest)
        mixed = rows.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"))
        return rows.drop("size").join(mixed.where("low < high").select("node", "size"), "node")

    both = F.lit(2)
    piece = F.xxhash64("node", F.pmod(F.xxhash64("rep", "node"), F.ceil(F.col("size") / SMALL_NODE)))
    first = placed.where(f"pick < {FIRST}").withColumns({"node": piece, "side": both, "root": F.col("rep")})
    forest = linked(None, first)
    level = staged(several(placed.where(f"pick >= {FIRST} OR size > {SMALL_NODE}"), forest), "nodes", own)
    for depth in range(DEPTH + 1):
        forest = linked(forest, level.where(f"size <= {SMALL_NODE}").withColumn("side", both))
        large = level.where(f"size > {SMALL_NODE}")
        if large.isEmpty():
            break
        # Pairs that have met in any whole node of a root are known here.
        large = several(large.drop("root"), forest).withColumn("pick", F.lit(heads))
        if depth == DEPTH:
            forest = linked(forest, _blocks(large))
            break
        children = (
            large.select("rep", "node").join(reps.select("rep", "mins"), "rep")
            .select("rep", F.explode(F.expr(_children("node"))).alias("node")).distinct().withColumn("pick", F.lit(heads))
        )
        level = staged(several(children, forest), "nodes", own)
    found = rooted(reps.select("rep", "s1", "s2", "n", "first"), forest)
    least_of = found.groupBy("root").agg(F.min("first").alias("least"))
    classes = found.join(least_of, "root").select("s1", "s2", "n", F.col("least.key").alias("component"), F.col("least.row").alias("kept_row"))
    out = profile.join(classes, ["s1", "s2", "n"], "left").withColumns(
        {"component": F.coalesce("component", "key"), "kept_row": F.coalesce("kept_row", "row")}
    )
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    out = out.select(
        real("key").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        real("component").alias("component_id"),
        (F.col("row") == F.col("kept_row")).alias("kept"),
        *(["mark"] if marks else []),
    )
    result = staged(out, "near-duplicates")
    discard(spark, own)
    return result


def _blocks(level: DataFrame) -> DataFrame:
    """Nodes cut into places of bounded size where all their components still meet.

    The rows of a node's largest component are dealt to blocks, and each block
    of the other rows meets each of these; the others meet among themselves.
    """
    half = SMALL_NODE // 2
    roots = level.groupBy("node", "root").agg(F.count("*").alias("mine"))
    main = roots.groupBy("node").agg(F.max(F.struct("mine", "root")).alias("main"))
    rows = level.join(main, "node").withColumns({
        "inner": F.col("root") == F.col("main.root"),
        "inner_blocks": F.ceil(F.col("main.mine") / half),
        "outer_blocks": F.ceil((F.col("size") - F.col("main.mine")) / half),
    })
    deal = lambda count: F.pmod(F.xxhash64("rep"), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    inner = rows.where("inner").withColumns({"i": deal("inner_blocks"), "side": F.lit(0)}).withColumn("o", every("outer_blocks"))
    outer = rows.where("NOT inner").withColumns({"o": deal("outer_blocks"), "side": F.lit(1)}).withColumn("i", every("inner_blocks"))
    across = inner.unionByName(outer, allowMissingColumns=True).withColumn("node", F.xxhash64("node", F.lit("across"), "i", "o"))
    among = rows.where("NOT inner").withColumn("block", deal("outer_blocks")).withColumn("other", every("outer_blocks"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    among = among.withColumns({
        "node": F.xxhash64("node", F.lit("among"), low, high),
        "side": F.when(F.col("outer_blocks") == 1, 2).when(low == high, 2).otherwise((F.col("block") < F.col("other")).cast("int")),
    })
    names = ("node", "rep", "root", "side", "pick")
    return across.select(*names).unionByName(among.select(*names))
