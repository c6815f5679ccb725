"""Cleaning operators on whole columns of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.dates import first_part_over_12, parse_dates
from shelfwise.functions.numbers import to_money, to_number
from shelfwise.functions.text import clean_text, name_col
from shelfwise.operators.profiling import is_text, text_columns


def trim_columns(
    df: DataFrame, columns: Sequence[str] | None = None, collapse: bool = False
) -> DataFrame:
    """Trim text columns and turn null words into nulls, in one projection.

    A column that the table does not have is an error; one that holds no text stays."""
    wanted = set(text_columns(df) if columns is None else columns)
    unknown = sorted(wanted - set(df.columns))
    if unknown:
        raise ValueError(f"no column {unknown} to trim among {df.columns}")
    return df.select(
        *[
            clean_text(name_col(c), collapse).alias(c)
            if c in wanted and is_text(df, c)
            else name_col(c)
            for c in df.columns
        ]
    )


def parse_number_column(df: DataFrame, column: str, money: bool = False) -> DataFrame:
    """Number text to double, or to exact money."""
    if column not in df.columns:
        return df
    parse = to_money if money else to_number
    return df.withColumn(column, parse(name_col(column)))


def infer_day_first(df: DataFrame, column: str) -> bool:
    """Whether some slash date of the column can only be day-first. One small job."""
    found = df.agg(F.bool_or(first_part_over_12(name_col(column))).alias("d")).first()
    return bool(found["d"])


def parse_date_column(
    df: DataFrame,
    column: str,
    day_first: bool | str = "infer",
    output_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """Mixed dates to ISO text; what is no date is kept."""
    if column not in df.columns:
        return df
    if day_first == "infer":
        day_first = infer_day_first(df, column)
    return df.withColumn(column, parse_dates(name_col(column), bool(day_first), output_format))
