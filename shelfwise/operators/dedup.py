"""Duplicate removal and table comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import name_col


def dedup_exact(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def null_score(df: DataFrame) -> Column:
    return reduce(Column.__add__, [name_col(c).isNull().cast("int") for c in df.columns])


def dedup_by_key(df: DataFrame, keys: Sequence[str], null_keys: str = "keep") -> DataFrame:
    """One row per key, the one with the fewest nulls; ties by the other columns.

    Each task passes on at most one row per key, so a frequent key costs one
    row per task in the shuffle. Rows with a null in the key are kept as they
    are (and not shuffled), or collapse like any key with ``"collapse"``.
    """
    if null_keys not in ("keep", "collapse"):
        raise ValueError(f"null_keys must be 'keep' or 'collapse', not {null_keys!r}")
    keys = list(keys)
    key_cols = [name_col(k) for k in keys]
    ties = [F.asc_nulls_first(name_col(c)) for c in df.columns if c not in keys]
    order = Window.partitionBy(*key_cols).orderBy(null_score(df), *ties)

    def best(rows):
        numbered = rows.withColumn("__position", F.row_number().over(order))
        return numbered.where("__position = 1").drop("__position")

    if null_keys == "collapse":
        return best(df)
    complete = reduce(Column.__and__, [k.isNotNull() for k in key_cols])
    return best(df.where(complete)).unionByName(df.where(~complete))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n) of every key that occurs more than once; nulls are equal."""
    return df.groupBy(*[name_col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number of copies differs between two tables, with the
    difference; both are combined in one shuffle."""
    columns = [name_col(c) for c in left.columns]
    both = left.withColumn("__side", F.lit(1)).unionByName(right.withColumn("__side", F.lit(-1)))
    return (
        both.groupBy(*columns).agg(F.sum("__side").alias("surplus")).where(F.col("surplus") != 0)
    )


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    if left.columns != right.columns:
        return False
    return differing_rows(left, right).isEmpty()
