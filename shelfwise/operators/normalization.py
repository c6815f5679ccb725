"""Category and brand names mapped to canonical ones, with confidence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.similarity import closest_term
from shelfwise.functions.text import name_col, normalize_sku, strip
from shelfwise.roles import resolve_role

# Category terms in order; an earlier term wins.
CATEGORY_TERMS = {
    "t-shirt": "Apparel - Tops",
    "tshirt": "Apparel - Tops",
    "tee": "Apparel - Tops",
    "t-shirts": "Apparel - Tops",
    "shirt": "Apparel - Tops",
    "hoodie": "Apparel - Outerwear",
    "sweatshirt": "Apparel - Outerwear",
    "jacket": "Apparel - Outerwear",
    "jeans": "Apparel - Bottoms",
    "denim": "Apparel - Bottoms",
    "pants": "Apparel - Bottoms",
    "trousers": "Apparel - Bottoms",
    "sneakers": "Footwear",
    "running shoes": "Footwear",
    "shoes": "Footwear",
    "boots": "Footwear",
    "laptop": "Electronics - Computers",
    "notebook": "Electronics - Computers",
    "macbook": "Electronics - Computers",
    "smartphone": "Electronics - Mobile",
    "phone": "Electronics - Mobile",
    "iphone": "Electronics - Mobile",
    "headphones": "Electronics - Audio",
    "earbuds": "Electronics - Audio",
}

# Brand synonyms in order.
BRAND_TERMS = {
    "nike": "Nike",
    "nike inc": "Nike",
    "nike sportswear": "Nike",
    "adidas": "Adidas",
    "adidas ag": "Adidas",
    "adidas originals": "Adidas",
    "apple": "Apple",
    "apple inc": "Apple",
    "sony": "Sony",
    "sony corp": "Sony",
    "samsung": "Samsung",
    "samsung electronics": "Samsung",
    "puma": "Puma",
    "puma se": "Puma",
}

# Thresholds and confidences.
BRAND_RATIO = 0.85
CATEGORY_RATIO = 0.80
SUBSTRING_CONFIDENCE = 0.9
UNKNOWN_BRAND_CONFIDENCE = 0.75
UNKNOWN_CATEGORY_CONFIDENCE = 0.6
CERTAIN = 0.85

Terms = Mapping[str, str]


def _canonical_at(terms: Terms, position: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in terms.values()]), position)


def _exact(text: Column, terms: Terms) -> Column:
    """The canonical name of a term, by one map lookup."""
    pairs = [F.lit(x) for pair in terms.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), text)


def _contained(text: Column, terms: Terms, match: str) -> Column:
    """The term found inside the text, or null.

    ``first``: the earliest term that is a substring. ``longest``: the longest
    term that stands there as whole words, the earliest on a tie.
    """
    order = list(terms)
    if match == "longest":
        order.sort(key=lambda t: -len(t))
    elif match != "first":
        raise ValueError(f"match must be 'first' or 'longest', not {match!r}")
    if match == "first":
        return F.coalesce(*[F.when(text.contains(t), F.lit(t)) for t in order])
    # Words between single spaces: a term stands there as a whole, between two of them.
    spaced = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}\-]+", " "), F.lit(" "))
    held = lambda words, t: words.contains(f" {t} ") if t else words.isNotNull()
    whole = [t for t in order if t == " ".join(t.split())]  # a run of words has no other white space
    if not whole:
        return F.lit(None).cast("string")
    return _bound(spaced, lambda words: F.coalesce(*[F.when(held(words, t), F.lit(t)) for t in whole]))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _result(missing, unknown, *cases) -> Column:
    """struct(value, confidence, note) from cases (condition, value, confidence, note)."""
    parts = []
    for at, name in enumerate(("value", "confidence", "note"), 1):
        column = F.when(missing[0], missing[at])
        for case in cases:
            column = column.when(case[0], case[at])
        parts.append(column.otherwise(unknown[at - 1]).alias(name))
    return F.struct(*parts)


def _fuzzy_note(lead: str, canonical: Column, ratio: Column) -> Column:
    shown = F.regexp_replace(F.format_string("%.2f", ratio), "0$", "")
    return F.concat(F.lit(f"{lead} '"), canonical, F.lit("' ("), shown, F.lit(")"))


def normalize_category(
    c: Column,
    terms: Terms = CATEGORY_TERMS,
    match: str = "longest",
    fuzzy: bool = True,
) -> Column:
    """struct(value, confidence, note): exact term, contained term, similar term,
    else the text itself. Only text no native rule settles reaches the
    similarity function, and nothing is shuffled."""
    text = strip(c.cast("string"))
    lower = F.lower(text)
    exact, term = _exact(lower, terms), _contained(lower, terms, match)
    missing = text.isNull() | (text == "")
    # Names and notes of missing and unknown text.
    settled = _bound(
        F.struct(missing.alias("missing"), exact.alias("exact"), term.alias("term")),
        lambda found: F.when(found["missing"], _entry(F.lit("Uncategorized"), F.lit(0.0), F.lit("Missing category")))
        .when(found["exact"].isNotNull(), _entry(found["exact"], F.lit(1.0), F.lit(None).cast("string")))
        .when(
            found["term"].isNotNull(),
            _entry(_exact(found["term"], terms), F.lit(SUBSTRING_CONFIDENCE), F.concat(F.lit("Substring matched '"), found["term"], F.lit("'"))),
        ),
    )
    result = F.when(settled.isNotNull(), settled)
    if fuzzy:
        open_text = F.when(exact.isNull() & term.isNull() & (lower != ""), lower)
        close = closest_term(list(terms), CATEGORY_RATIO, first=False)(open_text)
        name, ratio = _canonical_at(terms, close["position"]), close["ratio"]
        result = result.when(close["position"].isNotNull(), _entry(name, ratio, _fuzzy_note("Fuzzy matched", name, ratio)))
    return result.otherwise(
        _entry(F.initcap(text), F.lit(UNKNOWN_CATEGORY_CONFIDENCE), F.lit("Low confidence match; original preserved"))
    )


def _entry(value: Column, confidence: Column, note: Column) -> Column:
    return F.struct(value.alias("value"), confidence.alias("confidence"), note.alias("note"))


def normalize_brand(c: Column, terms: Terms = BRAND_TERMS, fuzzy: bool = True) -> Column:
    """struct(value, confidence, note): exact synonym, first similar synonym,
    else the text in title case."""
    text = strip(c.cast("string"))
    lower = F.lower(text)
    exact = _exact(lower, terms)
    cases = [(exact.isNotNull(), exact, F.lit(1.0), F.lit(None).cast("string"))]
    if fuzzy:
        open_text = F.when(exact.isNull() & (lower != ""), lower)
        close = closest_term(list(terms), BRAND_RATIO, first=True)(open_text)
        name, ratio = _canonical_at(terms, close["position"]), close["ratio"]
        cases.append((close["position"].isNotNull(), name, ratio, _fuzzy_note("Fuzzy matched to", name, ratio)))
    missing = text.isNull() | (text == "")
    # Names and notes of missing and unknown text.
    return _result(
        (missing, F.lit("Unknown"), F.lit(0.0), F.lit("Missing brand")),
        (
            F.initcap(text),
            F.lit(UNKNOWN_BRAND_CONFIDENCE),
            F.lit("Brand not in canonical taxonomy"),
        ),
        *cases,
    )


def enrich_products(
    df: DataFrame,
    columns: Mapping[str, str] | None = None,
    category_terms: Terms = CATEGORY_TERMS,
    brand_terms: Terms = BRAND_TERMS,
    match: str = "longest",
    fuzzy: bool = True,
) -> DataFrame:
    """Adds normalized category and brand with confidence, and a clean SKU."""
    category = resolve_role(df.columns, "category", columns)
    brand = resolve_role(df.columns, "brand", columns)
    sku = resolve_role(df.columns, "sku", columns)
    out = df
    if category:
        found = normalize_category(name_col(category), category_terms, match, fuzzy)
        out = out.withColumn("__c", found)
        out = out.withColumns(
            {
                f"{category}_normalized": F.col("__c.value"),
                f"{category}_confidence": F.col("__c.confidence"),
                f"{category}_uncertainty_note": F.col("__c.note"),
            }
        ).drop("__c")
    if brand:
        out = out.withColumn("__b", normalize_brand(name_col(brand), brand_terms, fuzzy))
        out = out.withColumns(
            {
                f"{brand}_normalized": F.col("__b.value"),
                f"{brand}_confidence": F.col("__b.confidence"),
            }
        ).drop("__b")
    if sku:
        out = out.withColumn(f"{sku}_clean", normalize_sku(name_col(sku))["value"])
    return out


def enrichment_stats(enriched: DataFrame, category: str = "category") -> DataFrame:
    """One row: rows, rows normalized with confidence, uncertain rows."""
    certain = name_col(f"{category}_confidence") >= CERTAIN
    return enriched.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(certain).alias("normalized_categories"),
        F.count_if(~certain).alias("uncertain_items"),
    )
