"""A dictionary of value shapes, so that rules on the form of text run once per shape.

In a shape, a run of digits is one digit and a run of letters one letter, but
for ``e``, which may stand in a number, and for texts as short as a truth word.
What the rules on numbers, money and white space ask of a text is the same for
its shape, so they are put to a few shapes of a column and multiplied by the
number of rows. Dates have rules on the digits themselves; columns that may
hold them are counted by value.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import name_col, strip

# Columns in one pass, so that the generated code of a pass stays small.
COLUMNS_PER_PASS = 12
#: Letters of the longest truth word.
SHORT = 5
SCHEMA = "column string, shape string, n bigint, binary bigint"


def shape(c: Column) -> Column:
    digits = F.regexp_replace(c, "[0-9]+", "9")
    letters = F.regexp_replace(digits, "[A-DF-Za-df-z]+", "a")
    return F.when(F.length(strip(c)) <= SHORT, digits).otherwise(letters)


def shape_counts(df: DataFrame, columns: Sequence[str], text: Collection[str], whole: Collection[str] = ()) -> DataFrame:
    """(column, shape, n, binary): rows of each shape, and how many of them are just 0 or 1.

    Null has the shape null; values of a column not in ``text`` have an empty
    one, those of a column in ``whole`` are their own. Each column has at least
    one row, of no rows if need be. One shuffle, combined before it.
    """

    def entry(column):
        c = name_col(column)
        if column not in text:
            return F.struct(F.lit(column).alias("column"), F.when(c.isNotNull(), F.lit("")).alias("shape"), F.lit(False).alias("one"))
        key = c if column in whole else shape(c)
        return F.struct(F.lit(column).alias("column"), key.alias("shape"), F.coalesce(strip(c).isin("0", "1"), F.lit(False)).alias("one"))

    parts = [df.sparkSession.createDataFrame([(c, None, 0, 0) for c in columns], SCHEMA)]
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        entries = [entry(c) for c in columns[start : start + COLUMNS_PER_PASS]]
        parts.append(
            df.select(F.inline(F.array(*entries))).groupBy("column", "shape")
            .agg(F.count("*").alias("n"), F.count_if("one").alias("binary"))
        )
    return reduce(DataFrame.unionByName, parts)
