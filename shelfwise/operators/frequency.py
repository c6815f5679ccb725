"""Long-form values, value counts and per-column aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import name_col

# Columns aggregated in one pass. Few, so that the generated code stays small
# enough to be compiled well; a further pass reads other columns only.
COLUMNS_PER_PASS = 4


def long_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value) with every value as text, nulls left out."""
    columns = list(columns if columns is not None else df.columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string")
    text = df.select(*[name_col(c).cast("string").alias(c) for c in columns])
    return text.unpivot([], [name_col(c) for c in columns], "column", "value").where(
        F.col("value").isNotNull()
    )


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n): one shuffle, combined on the map side first."""
    return long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    prepare: Callable[..., dict[str, Column]],
    aggregate: Callable[[str, dict[str, Column]], dict[str, Column]],
    shared: Callable[[str], dict[str, Column]] | None = None,
) -> DataFrame:
    """One row per column from global aggregates; no value is shuffled.

    ``prepare`` gives the expressions evaluated once per row, ``aggregate``
    the aggregates over them. ``shared`` gives expressions several prepared
    ones need: they are computed in a projection of their own and passed to
    ``prepare``. Without columns the result has its schema and no row.
    """
    if not columns:
        return per_column(df, df.columns[:1], prepare, aggregate, shared).where("false")
    passes = []
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        inputs, rows, before = [], [], []
        for position, column in enumerate(columns[start : start + COLUMNS_PER_PASS]):
            prepared, common = {}, ()
            if shared is not None:
                named = shared(column)
                before += [e.alias(f"__{k}{position}") for k, e in named.items()]
                common = ({k: F.col(f"__{k}{position}") for k in named},)
            for key, expression in prepare(column, *common).items():
                inputs.append(expression.alias(f"{key}{position}"))
                prepared[key] = F.col(f"{key}{position}")
            values = aggregate(column, prepared)
            rows.append(
                F.struct(F.lit(column).alias("column"), *[v.alias(k) for k, v in values.items()])
            )
        source = df.select(*before) if before else df
        passes.append(source.select(*inputs).agg(F.array(*rows).alias("rows")).select(F.inline("rows")))
    return reduce(DataFrame.unionByName, passes)


def top_values(counts: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values of each column, ties by value.

    The rank filter is applied before the shuffle as well, so each task sends
    at most k rows per column.
    """
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    ranked = counts.withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= k)


def sample_values(counts: DataFrame, k: int = 5) -> DataFrame:
    """The k smallest distinct values of each column."""
    order = Window.partitionBy("column").orderBy(F.asc("value"))
    ranked = counts.withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= k).select("column", "position", "value")


def duplicate_groups(df: DataFrame) -> DataFrame:
    """(row as struct, n) for every row that occurs more than once; nulls are equal."""
    columns = [name_col(c) for c in df.columns]
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    return counted.where("__n > 1").select(F.struct(*columns).alias("row"), F.col("__n").alias("n"))


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows and the difference."""
    columns = [name_col(c) for c in df.columns]
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    rows = F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint")
    return counted.agg(
        rows.alias("row_count"),
        F.count(F.lit(1)).alias("distinct_row_count"),
        (rows - F.count(F.lit(1))).alias("duplicate_row_count"),
    )
