"""Trimming, null words, title case and SKU normalization."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
INVISIBLE = "\u00a0\u200b\ufeff"
NULL_WORDS = ("nan", "None", "null", "NULL", "", "N/A")
NULL_WORDS_LOWER = ("nan", "none", "null", "", "n/a")
TITLE_NULL_WORDS = ("nan", "none", "null", "")


def name_col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def round2(c: Column) -> Column:
    """Two decimals, rounded half away from zero on the decimal value."""
    return F.round(c.cast("decimal(38,6)"), 2)


def clean_text(c: Column, collapse: bool = False) -> Column:
    """Invisible characters to spaces, trimmed, null words to null."""
    text = strip(F.translate(c.cast("string"), INVISIBLE, " " * len(INVISIBLE)))
    if collapse:
        text = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.when(~text.isin(*NULL_WORDS), text)


def is_padded(c: Column) -> Column:
    return c != strip(c)


def title_case(c: Column) -> Column:
    """Each word capitalized; all-upper words of at most four letters stay."""
    text = strip(c.cast("string"))
    words = F.transform(
        F.split(text, r"(?U)\s+"),
        lambda w: F.when((F.upper(w) == w) & (F.length(w) <= 4), w).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
        ),
    )
    return F.when(~F.lower(text).isin(*TITLE_NULL_WORDS), F.array_join(words, " "))


def normalize_sku(c: Column) -> Column:
    """struct(value, confidence, note)."""
    text = F.upper(strip(c.cast("string")))
    bare = F.regexp_replace(text, r"(?U)[\s\-_]", "")
    size = F.length(bare)
    missing = text.isNull() | (text == "")
    odd = ~bare.rlike(r"^[\p{L}\p{N}]+$")
    unusual = (size < 4) | (size > 20)
    return F.struct(
        F.when(missing, F.lit(None)).when(odd, text).otherwise(bare).alias("value"),
        F.when(missing, 0.0).when(odd, 0.5).when(unusual, 0.7).otherwise(1.0).alias("confidence"),
        F.when(missing, "Missing SKU")
        .when(odd, "Non-alphanumeric characters present")
        .when(unusual, F.format_string("Unusual SKU length (%d)", size))
        .alias("note"),
    )
