"""Language identification by prediction by partial matching (PPM).

For each language, the bytes of a sample of its documents fill context trees of
order 0 to ``order``. The code length of a byte is that of its longest known
context; a byte not seen there costs an escape and is coded one order lower
(method C: a context of n bytes of which d differ escapes with d / (n + d)).
The statistics are frozen, so each byte sequence of ``order + 1`` bytes has one
code length per language: these are worked out once, and a text is scored by
looking up its sequences and adding up.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.batches import Shared, bytes_of, offsets_of, slices
from shelfwise.llm.chosen_path import lowered

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 4
#: Bounds of the sample that is fitted: documents of each language and in all (but one of each language), bytes of each.
SAMPLE_DOCS, SAMPLE_TOTAL, SAMPLE_BYTES = 400, 80_000, 64 << 20
#: Bytes of text that are scored at once; the arrays for each of them take some hundred bytes.
SCORED_BYTES = 1 << 18
UNKNOWN = "und"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` ones before it in its text, packed; a text starts after line feeds."""
    out = data.astype(np.uint64)
    ends = np.repeat(offsets[:-1], np.diff(offsets))
    depth = np.arange(len(data)) - ends
    for k in range(1, order + 1):
        before = np.full(len(data), 10, np.uint64)
        before[k:] = data[:-k] if k < len(data) else data[:0]
        before[depth < k] = 10
        out |= before << np.uint64(8 * k)
    return out


class Table:
    """Row numbers of packed sequences: open addressing, whole arrays at a time."""

    def __init__(self, keys: np.ndarray):
        self.bits = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.bits))
        self.keys, self.rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.mask = np.int64(size - 1)
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = self.rows[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            own = left[free][first]
            self.keys[slot], self.rows[slot] = keys[own], own
            rest = self.rows[at] != left
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self.bits).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        at = self._home(keys)
        out = self.rows[at]
        wrong = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            out[wrong] = self.rows[at[wrong]]
            wrong = wrong[(self.keys[at[wrong]] != keys[wrong]) & (out[wrong] >= 0)]
        return out


class Model:
    """Frozen code lengths in bits. ``counts``: (language index, sequence) to count, of the longest order."""

    def __init__(self, languages: list[str], language: np.ndarray, gram: np.ndarray, count: np.ndarray, order: int):
        self.languages, self.order = languages, order
        self.symbols: list[tuple[Table, np.ndarray]] = []
        self.contexts: list[tuple[Table, np.ndarray]] = []
        n_lang = len(languages)
        below_keys, below = None, None
        for k in range(order + 1):
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            keys, row = np.unique(gram & mask, return_inverse=True)
            seen = np.zeros((len(keys), n_lang))
            np.add.at(seen, (row, language), count)
            parents, parent = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((2, len(parents), n_lang))
            np.add.at(total, parent, seen)
            np.add.at(kinds, parent, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                direct = -np.log2(seen / (total + kinds)[parent])
            if k == 0:
                lower = np.full((len(keys), n_lang), 8.0)
            else:
                lower = below[np.searchsorted(below_keys, keys & (mask >> np.uint64(8)))]
            cost = np.where(seen > 0, direct, escape[parent] + lower)
            self.symbols.append((Table(keys), cost.astype(np.float32)))
            self.contexts.append((Table(parents), escape.astype(np.float32)))
            below_keys, below = keys, cost

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language; each text has a byte at least."""
        gram = grams(data, offsets, self.order)
        cost = np.zeros((len(data), len(self.languages)), np.float32)
        left = np.arange(len(data))
        for k in range(self.order, -1, -1):
            table, known = self.symbols[k]
            own = gram[left] & np.uint64((1 << (8 * (k + 1))) - 1)
            row = table.find(own)
            hit = row >= 0
            cost[left[hit]] += known[row[hit]]
            left, own = left[~hit], own[~hit]
            if not len(left):
                break
            table, escape = self.contexts[k]
            row = table.find(own >> np.uint64(8))
            hit = row >= 0
            cost[left[hit]] += escape[row[hit]]
        cost[left] += 8.0 if len(left) else 0
        return np.add.reduceat(cost.astype(np.float64), offsets[:-1], axis=0)


def _counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 20):
            data, offsets = lowered(bytes_of(part.column("text"))), offsets_of(part.column("text"))
            all_grams = grams(data, offsets, order)
            for i, language in enumerate(part.column("lang").to_pylist()):
                found, count = np.unique(all_grams[offsets[i] : offsets[i + 1]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(count)],
                    names=["lang", "gram", "n"],
                )

    return run


def fit(
    df: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model | None:
    """A model of the labelled rows of ``df``, or None if there are none.

    The sample is bounded, and every label is learned: of each at most
    ``sample_docs`` documents, fewer with very many labels, drawn by a hash of
    id and text, whole, until they have ``SAMPLE_BYTES``. Only its byte
    statistics come to the driver.
    """
    rows = df.select(
        df[id_col].cast("string").alias("id"), df[text_col].cast("string").alias("text"),
        df[lang_col].cast("string").alias("lang"),
    ).where("text <> '' AND lang IS NOT NULL")
    # One row for each label; the model on the driver holds a table of bytes for each of them anyway.
    known = rows.groupBy("lang").agg(F.count("*").alias("docs"))
    names = sorted(r["lang"] for r in known.collect())
    if not names:
        return None
    most = max(1, min(sample_docs, SAMPLE_TOTAL // len(names)))
    # About twice the sample passes a bound on the hash; only that is ranked, whatever the table's size.
    share = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) / float(1 << 40)
    order_by = Window.partitionBy("lang").orderBy(F.xxhash64("id", "text"))
    size = F.sum(F.octet_length("text")).over(order_by.rowsBetween(Window.unboundedPreceding, -1))
    few = (
        rows.join(F.broadcast(known), "lang").where(share < (2.0 * most + 20) / F.col("docs"))
        .withColumns({"place": F.row_number().over(order_by), "before": F.coalesce(size, F.lit(0))})
        .where((F.col("place") <= most) & (F.col("before") < SAMPLE_BYTES))
    )
    found = (
        few.select("text", "lang")
        .mapInArrow(_counts(order), "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    )
    index = {name: i for i, name in enumerate(names)}
    language = np.array([index[x] for x in found.column("lang").to_pylist()], np.int64)
    gram = found.column("gram").to_numpy().view(np.uint64)
    return Model(names, language, gram, found.column("n").to_numpy(), order)


_KIND = "struct<lang: string, score: double>"


def language_of(spark, model: Model | None, text: Column) -> Column:
    """struct(lang, score) of a text column: the language of the shortest code and its share in 2 ** -bits."""
    shared = Shared(spark, model)

    @F.arrow_udf(_KIND)
    def predict(texts: pa.Array) -> pa.Array:
        own = shared.value
        names = np.array([*(own.languages if own else []), UNKNOWN], dtype=object)
        n = len(texts)
        best, score = np.full(n, len(names) - 1), np.zeros(n)
        start = 0
        batch = pa.RecordBatch.from_arrays([texts.fill_null("")], names=["text"])
        for part in slices(iter([batch]), limit=SCORED_BYTES) if own else ():
            column = part.column("text")
            data, offsets = lowered(bytes_of(column)), offsets_of(column)
            letter = np.r_[0, np.cumsum((data >= 97) & (data <= 122))]
            has = letter[offsets[1:]] > letter[offsets[:-1]]
            for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
                has[i] = any(c.isalpha() for c in column[int(i)].as_py())
            if has.any():
                full = np.flatnonzero(np.diff(offsets) > 0)  # empty texts add nothing to the bytes
                bits = own.bits(data, np.r_[offsets[full], offsets[-1]])
                take = has[full]
                bits, at = bits[take], start + full[take]
                least = bits.min(axis=1, keepdims=True)
                best[at] = bits.argmin(axis=1)
                score[at] = 1.0 / np.exp2(np.maximum(least - bits, -1000.0)).sum(axis=1)
            start += part.num_rows
        return pa.StructArray.from_arrays(
            [pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["lang", "score"]
        )

    return predict(text.cast("string"))


def predict_languages(
    df: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", **bounds,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``df``.

    Rows where ``held_out`` is true or null are not learned from (default: those
    with ``crc32(id) % 4 = 2``). Null text and text without a letter are ``und``
    with score 0, as is everything if there is nothing to learn from. Ties go to
    the language that sorts first. Repeated rows count each, a null id stays
    null, an empty table gives no rows, further columns are ignored.
    """
    if held_out is None:
        held_out = F.crc32(df[id_col].cast("string").cast("binary")) % 4 == 2
    model = fit(df.where(~held_out), id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds)
    found = df.select(
        df[id_col].cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        language_of(df.sparkSession, model, df[text_col]).alias("found"),
    )
    return found.select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )
