"""Currency and number text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.text import name_col, strip

# Fixed values.
CURRENCY_SIGNS = "$,€£¥% "
NUMBER_PATTERN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
# A grouped number holds a comma, so the first sign class covers it.
CURRENCY_PATTERN = r"[$,€£¥]|^\(\d+(\.\d+)?\)$"
CURRENCY_ANY = r"[$,€£¥]|\(\d+(\.\d+)?\)"

# Exact to six decimals and 24 digits before them; sums have 38 digits.
MONEY = "decimal(30,6)"


# Stands before a text found negative by its form, until its own sign is known.
NEGATIVE = "\u0001"


def _formatted_number(c: Column) -> Column:
    marked = F.regexp_replace(strip(c), r"^(?:\((.*)\)|(.*)-)$", NEGATIVE + "$1$2")
    bare = F.translate(marked, CURRENCY_SIGNS, "")
    signed = F.regexp_replace(
        F.regexp_replace(bare, f"^{NEGATIVE}-", ""), rf"^{NEGATIVE}\+?", "-"
    )
    return F.when(bare.rlike(NUMBER_PATTERN.replace("^", f"^{NEGATIVE}?", 1)), signed)


def number_text(c: Column) -> Column:
    """The text of the number in ``c``, or null where there is none.

    ``(x)`` and ``x-`` are negative; a percent sign does not divide. Plain
    numbers, dates and text without any digit are settled by one test each.
    The input is referred to only a few times, so that a filter on a computed
    column stays small after it is pushed below the projection.
    """
    text = c.cast("string")
    return (
        F.when(text.rlike(NUMBER_PATTERN), text)
        .when(text.rlike(r"\d[-/:]\d"), F.lit(None))
        .when(text.rlike(r"\d"), _formatted_number(text))
    )


def to_number(c: Column) -> Column:
    return number_text(c).try_cast("double")


def to_money(c: Column) -> Column:
    return number_text(c).try_cast(MONEY)


def looks_like_currency(c: Column) -> Column:
    return c.rlike(CURRENCY_PATTERN)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def number_of(df: DataFrame, column: str) -> Column:
    """A column as double: as it is when typed, parsed when text, NaN to null."""
    kind = df.schema[column].dataType
    c = name_col(column)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if is_numeric(kind):
        return c.cast("double")
    return to_number(c)


def money_of(df: DataFrame, column: str) -> Column:
    """A column as exact money."""
    if is_numeric(df.schema[column].dataType):
        return name_col(column).try_cast(MONEY)
    return to_money(name_col(column))
