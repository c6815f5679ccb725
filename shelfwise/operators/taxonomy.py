"""Names mapped to a taxonomy that is a table, of any number of terms.

The rules are those of ``normalization``; here terms are rows (term, name,
place) and are looked up by joins: an exact text by the term, a contained term
by its first word or first characters, a similar one by shared pairs of
characters. Only distinct texts take part, and each step takes what the steps
before it left open, so the similarity function sees distinct leftovers only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.similarity import levenshtein_similarity, matcher_ratio
from shelfwise.functions.text import name_col, strip
from shelfwise.operators.normalization import (
    BRAND_RATIO,
    CATEGORY_RATIO,
    SUBSTRING_CONFIDENCE,
    UNKNOWN_BRAND_CONFIDENCE,
    UNKNOWN_CATEGORY_CONFIDENCE,
)

#: Characters of a term that its texts are looked up by.
HEAD = 3


@F.pandas_udf(T.DoubleType())
def _ratio(text: pd.Series, term: pd.Series) -> pd.Series:
    return pd.Series([matcher_ratio(a, b) for a, b in zip(text, term)], dtype="float64")


def _terms(taxonomy: DataFrame) -> DataFrame:
    """(term, name, place), the earliest row of each term; white space and case do not count."""
    rows = taxonomy.select(F.lower(strip(F.col("term"))).alias("term"), "name", F.col("place").cast("long").alias("place"))
    first = rows.where("term <> ''").groupBy("term").agg(F.min(F.struct("place", "name")).alias("t"))
    return first.select("term", "t.name", "t.place")


def _words(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"[^\p{L}\p{N}\-]+", " "), " ")


def _runs(text: Column, size: int) -> Column:
    """All runs of ``size`` characters; a shorter text is one."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.transform(places, lambda i: F.substring(text, i, F.lit(size)))


def _contained(texts: DataFrame, terms: DataFrame, match: str) -> DataFrame:
    """(text, term, name): the longest term that stands in a text as whole words, or the first that is part of it."""
    if match == "longest":
        words = texts.select("text", _words(F.col("text")).alias("words"))
        starts = words.select("text", "words", F.posexplode("words").alias("at", "head"))
        parts = F.split("term", " ")
        known = terms.select("*", F.get(parts, F.lit(0)).alias("head"), F.size(parts).alias("size"))
        run = F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ")
        found = starts.join(known, "head").where(run == F.col("term"))
        order = F.struct(-F.length("term"), "place")
    elif match == "first":
        heads = F.array_distinct(F.concat(*[_runs(F.col("text"), n) for n in range(1, HEAD + 1)]))
        starts = texts.select("text", F.explode(heads).alias("head"))
        known = terms.withColumn("head", F.substring("term", 1, HEAD))
        found = starts.join(known, "head").where(F.contains("text", "term"))
        order = F.struct(F.col("place"))
    else:
        raise ValueError(f"match must be 'first' or 'longest', not {match!r}")
    best = found.groupBy("text").agg(F.min_by(F.struct("term", "name"), order).alias("t"))
    return best.select("text", "t.term", "t.name")


def _pairs_of_characters(text: Column) -> Column:
    return F.array_distinct(_runs(F.concat(F.lit("\u0002"), text, F.lit("\u0003")), 2))


def _similar(texts: DataFrame, terms: DataFrame, ratio: float, first: bool, measure: str) -> DataFrame:
    """(text, name, ratio): the most similar term at or above ``ratio``, the earliest on a tie; or the first of them.

    Two texts at or above a ratio of two thirds share a pair of neighbouring
    characters, and no more characters than that leaves over tell them apart.
    """
    left = texts.select("text", F.explode(_pairs_of_characters(F.col("text"))).alias("pair"))
    right = terms.select("*", F.explode(_pairs_of_characters(F.col("term"))).alias("pair"))
    a, b = F.length("text"), F.length("term")
    over = F.floor((1 - ratio) * (a + b) + 1e-9)
    met = (
        left.join(right, "pair").where((F.abs(a - b) <= over) & (F.levenshtein("text", "term") <= over))
        .select("text", "term", "name", "place").distinct()
    )
    score = _ratio if measure == "blocks" else levenshtein_similarity
    scored = met.withColumn("ratio", score(F.col("text"), F.col("term"))).where(F.col("ratio") >= ratio)
    order = F.struct("place") if first else F.struct((-F.col("ratio")).alias("r"), "place")
    best = scored.groupBy("text").agg(F.min_by(F.struct("name", "ratio"), order).alias("t"))
    return best.select("text", "t.name", F.round("t.ratio", 2).alias("ratio"))


def normalize_by(
    df: DataFrame,
    column: str,
    taxonomy: DataFrame,
    kind: str = "category",
    match: str = "longest",
    fuzzy: bool = True,
    measure: str = "blocks",
) -> DataFrame:
    """Adds ``<column>_value``, ``<column>_confidence`` and ``<column>_note``.

    ``taxonomy`` has term, name and place; an earlier place wins. ``kind``
    "category" also looks for terms inside the text, as ``match`` says, and takes
    the most similar term; "brand" takes the first similar one.
    """
    category = kind == "category"
    if kind not in ("category", "brand"):
        raise ValueError(f"kind must be 'category' or 'brand', not {kind!r}")
    text = strip(name_col(column).cast("string"))
    terms = _terms(taxonomy)
    texts = df.select(F.lower(text).alias("text")).where("text <> ''").distinct()
    none = F.lit(None).cast("string")
    looked = texts.join(terms.select(F.col("term").alias("text"), F.col("name")), "text", "left")
    parts = [looked.where("name IS NOT NULL").select("text", "name", F.lit(1.0).alias("confidence"), none.alias("note"))]
    left = looked.where("name IS NULL").select("text")
    if category:
        held = left.join(_contained(left, terms, match), "text", "left")
        note = F.concat(F.lit("Substring matched '"), "term", F.lit("'"))
        parts.append(held.where("name IS NOT NULL").select("text", "name", F.lit(SUBSTRING_CONFIDENCE).alias("confidence"), note.alias("note")))
        left = held.where("name IS NULL").select("text")
    if fuzzy:
        near = _similar(left, terms, CATEGORY_RATIO if category else BRAND_RATIO, not category, measure)
        shown = F.regexp_replace(F.format_string("%.2f", "ratio"), "0$", "")
        lead = "Fuzzy matched '" if category else "Fuzzy matched to '"
        note = F.concat(F.lit(lead), "name", F.lit("' ("), shown, F.lit(")"))
        parts.append(near.select("text", "name", F.col("ratio").alias("confidence"), note.alias("note")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.select(F.col("text").alias("__text"), F.struct("name", "confidence", "note").alias("__found"))
    joined = df.join(found, F.lower(text) == F.col("__text"), "left")
    # Names and notes of missing and unknown text.
    missing = ("Uncategorized", "Missing category") if category else ("Unknown", "Missing brand")
    unknown = "Low confidence match; original preserved" if category else "Brand not in canonical taxonomy"
    low = UNKNOWN_CATEGORY_CONFIDENCE if category else UNKNOWN_BRAND_CONFIDENCE
    empty, hit = text.isNull() | (text == ""), F.col("__found").isNotNull()

    def chosen(none, field, other):
        return F.when(empty, none).when(hit, F.col(f"__found.{field}")).otherwise(other)

    return joined.withColumns({
        f"{column}_value": chosen(F.lit(missing[0]), "name", F.initcap(text)),
        f"{column}_confidence": chosen(F.lit(0.0), "confidence", F.lit(low)),
        f"{column}_note": chosen(F.lit(missing[1]), "note", F.lit(unknown)),
    }).drop("__text", "__found")
