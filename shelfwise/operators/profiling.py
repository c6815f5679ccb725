"""Table and column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.dates import to_iso_date
from shelfwise.functions.numbers import number_of
from shelfwise.functions.text import name_col, round2, strip
from shelfwise.operators.frequency import (
    duplicate_row_count,
    long_values,
    per_column,
    sample_values,
    top_values,
    value_counts,
)
from shelfwise.operators.quantiles import exact_percentiles
from shelfwise.roles import has_role
from shelfwise.session import stage

# Fixed values.
BOOLEAN_WORDS = ("true", "false", "0", "1", "yes", "no", "t", "f", "y", "n")
CATEGORY_MAX_DISTINCT = 30
CATEGORY_MAX_RATIO = 0.2
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def table_profile(df: DataFrame, dataset: str) -> DataFrame:
    counts = duplicate_row_count(df)
    return counts.select(
        F.lit(dataset).alias("dataset"),
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        "duplicate_row_count",
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, null_count, null_percentage)."""
    columns = list(df.columns if columns is None else columns)

    def aggregate(column, values):
        rows, filled = F.count(F.lit(1)), F.count(values["v"])
        return {"row_count": rows, "null_count": rows - filled}

    counted = per_column(df, columns, lambda c: {"v": name_col(c)}, aggregate)
    return counted.select("column", "null_count", _percentage("null_count").alias("null_percentage"))


def _percentage(count: str) -> Column:
    share = F.try_divide(F.col(count).cast("double") * 100, F.col("row_count"))
    return F.coalesce(round2(share).cast("double"), F.lit(0.0))


def distinct_counts(
    df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """(column, distinct_count) of non-null values.

    Exact counting shuffles each column's distinct values once. ``approx``
    keeps a sketch per column instead and shuffles nothing.
    """
    columns = list(df.columns if columns is None else columns)
    if approx:
        return per_column(
            df,
            columns,
            lambda c: {"v": name_col(c)},
            lambda c, v: {"distinct_count": F.approx_count_distinct(v["v"])},
        )
    return value_counts(df, columns).groupBy("column").agg(F.count("value").alias("distinct_count"))


def column_signals(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Counts and number and date ranges of each column, from one scan."""
    columns = list(df.columns if columns is None else columns)

    def prepare(column):
        kind = df.schema[column].dataType
        c = name_col(column)
        dated = is_temporal(kind) or (isinstance(kind, T.StringType) and has_role(column, "date"))
        number = F.lit(None).cast("double") if is_temporal(kind) else number_of(df, column)
        date = to_iso_date(c) if dated else F.lit(None).cast("date")
        return {
            "v": c,
            "word": F.lower(strip(c.cast("string"))).isin(*BOOLEAN_WORDS),
            "x": number,
            "d": date,
        }

    def aggregate(column, v):
        rows, filled = F.count(F.lit(1)), F.count(v["v"])
        return {
            "row_count": rows,
            "value_count": filled,
            "null_count": rows - filled,
            "boolean_count": F.count_if(v["word"]),
            "number_count": F.count(v["x"]),
            "date_count": F.count(v["d"]),
            "min": F.min(v["x"]),
            "max": F.max(v["x"]),
            "mean": F.avg(v["x"]),
            "std": F.coalesce(F.stddev_samp(v["x"]), F.when(F.count(v["x"]) == 1, 0.0)),
            "min_date": F.min(v["d"]).cast("string"),
            "max_date": F.max(v["d"]).cast("string"),
        }

    return per_column(df, columns, prepare, aggregate)


def semantic_type(columns: Sequence[str]) -> Column:
    """The type rule over column, value_count, boolean_count, number_count,
    date_count and distinct_count; the first rule that holds decides."""

    def named(role):
        return F.col("column").isin(*[c for c in columns if has_role(c, role)] or [""])

    filled = F.col("value_count")
    ratio = F.col("distinct_count").cast("double") / filled
    return (
        F.when(filled == 0, "empty")
        .when(named("identifier"), "identifier")
        .when(F.col("boolean_count") == filled, "boolean")
        .when((F.col("number_count") == filled) & named("currency"), "currency")
        .when(F.col("number_count") == filled, "numeric")
        .when(F.col("date_count") == filled, "datetime")
        .when(
            (ratio < CATEGORY_MAX_RATIO) | (F.col("distinct_count") <= CATEGORY_MAX_DISTINCT),
            "categorical",
        )
        .otherwise("text")
    )


def typed_signals(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False):
    """Signals of each column with its distinct count and inferred type."""
    columns = list(df.columns if columns is None else columns)
    # Both sides hold one row per column of the table.
    joined = column_signals(df, columns).join(
        F.broadcast(distinct_counts(df, columns, approx)), "column", "left"
    )
    filled = joined.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
    return filled.withColumn("inferred_type", semantic_type(columns))


def infer_types(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False):
    return typed_signals(df, columns, approx).select("column", "inferred_type")


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False):
    """(column, distinct_count, cardinality_ratio over all rows, is_unique)."""
    columns = list(df.columns if columns is None else columns)

    def aggregate(column, values):
        rows, filled = F.count(F.lit(1)), F.count(values["v"])
        return {"row_count": rows, "null_count": rows - filled}

    rows = per_column(df, columns, lambda c: {"v": name_col(c)}, aggregate)
    joined = rows.join(F.broadcast(distinct_counts(df, columns, approx)), "column", "left")
    filled = joined.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
    return filled.select("column", "distinct_count", _ratio().alias("cardinality_ratio"), _unique())


def _ratio() -> Column:
    share = F.try_divide(F.col("distinct_count").cast("double"), F.col("row_count"))
    return F.coalesce(F.round(share.cast("decimal(28,8)"), 4).cast("double"), F.lit(0.0))


def _unique() -> Column:
    full = (F.col("distinct_count") == F.col("row_count")) & (F.col("null_count") == 0)
    return full.alias("is_unique")


def long_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, x) of every value that is a number."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, x double")
    numbers = df.select(*[number_of(df, c).alias(c) for c in columns])
    return numbers.unpivot([], [name_col(c) for c in columns], "column", "x").where("x IS NOT NULL")


def quartiles(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """(column, q25, median, q75)."""
    numbers = long_numbers(df, columns)
    if approx:
        found = numbers.groupBy("column").agg(
            F.percentile_approx("x", list(QUARTILES.values()), 10_000).alias("q")
        )
        return found.select(
            "column", *[F.col("q")[i].alias(name) for i, name in enumerate(QUARTILES)]
        )
    found = exact_percentiles(numbers, list(QUARTILES.values()))
    return found.groupBy("column").agg(
        *[F.max(F.when(F.col("probability") == p, F.col("value"))).alias(name)
          for name, p in QUARTILES.items()]
    )


STAT_COLUMNS = ("min", "max", "mean", "median", "std", "q25", "q75")


def numeric_stats(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """min, max, mean, median, std, q25 and q75 at two decimals."""
    columns = list(columns)

    def aggregate(column, v):
        return {
            "min": F.min(v["x"]),
            "max": F.max(v["x"]),
            "mean": F.avg(v["x"]),
            "std": F.coalesce(F.stddev_samp(v["x"]), F.when(F.count(v["x"]) == 1, 0.0)),
        }

    base = per_column(df, columns, lambda c: {"x": number_of(df, c)}, aggregate)
    joined = base.join(F.broadcast(quartiles(df, columns, approx)), "column", "left")
    return joined.select("column", *[round2(F.col(s)).cast("double").alias(s) for s in STAT_COLUMNS])


def datetime_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min_date, max_date) of the values that are dates."""
    return per_column(
        df,
        list(columns),
        lambda c: {"d": to_iso_date(name_col(c))},
        lambda c, v: {
            "min_date": F.min(v["d"]).cast("string"),
            "max_date": F.max(v["d"]).cast("string"),
        },
    )


def parse_failures(
    df: DataFrame, numeric: Sequence[str] = (), dates: Sequence[str] = ()
) -> DataFrame:
    """(column, parse_failures): non-null values that do not parse."""
    kinds = {**{c: "number" for c in numeric}, **{c: "date" for c in dates}}

    def prepare(column):
        c = name_col(column)
        parsed = number_of(df, column) if kinds.get(column) == "number" else to_iso_date(c)
        return {"bad": c.isNotNull() & parsed.isNull()}

    return per_column(
        df, list(kinds), prepare, lambda c, v: {"parse_failures": F.count_if(v["bad"])}
    )


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column with every statistic of the profile.

    ``approx`` uses sketches for distinct counts and quartiles, and counts
    values only in the columns found to be categorical (a small job decides).
    """
    columns = df.columns
    if approx:
        typed = typed_signals(df, approx=True)
        kinds = typed.select("column", "inferred_type").collect()  # one row per column
        categorical = [r["column"] for r in kinds if r["inferred_type"] == "categorical"]
        counts = value_counts(df, categorical) if categorical else None
        distinct_values = long_values(df).distinct()
    else:
        # Distinct counts, samples and frequencies come from one counted table.
        counts = stage(value_counts(df), "value-counts")
        distinct = counts.groupBy("column").agg(F.count("value").alias("distinct_count"))
        typed = (
            column_signals(df)
            .join(F.broadcast(distinct), "column", "left")
            .withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
            .withColumn("inferred_type", semantic_type(columns))
        )
        distinct_values = counts
    samples = sample_values(distinct_values).groupBy("column").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", "value"))), lambda e: e["value"]
        ).alias("sample_values")
    )
    numeric = [c for c in columns if not is_temporal(df.schema[c].dataType)]
    if counts is not None:
        top = top_values(counts).groupBy("column").agg(
            F.map_from_entries(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("position", "value", "n"))),
                    lambda e: F.struct(e["value"], e["n"]),
                )
            ).alias("top_frequencies")
        )
    else:
        top = typed.select("column", F.lit(None).cast("map<string,bigint>").alias("top_frequencies"))
    # Every joined side holds at most one row per column of the table.
    joined = typed
    sides = [top, samples] + ([quartiles(df, numeric, approx)] if numeric else [])
    for side in sides:
        joined = joined.join(F.broadcast(side), "column", "left")
    for stat in QUARTILES:
        if stat not in joined.columns:
            joined = joined.withColumn(stat, F.lit(None).cast("double"))
    kind = F.col("inferred_type")
    is_number, is_date = kind.isin("numeric", "currency"), kind == "datetime"
    parsed = F.when(is_number, F.col("number_count")).when(is_date, F.col("date_count"))
    return joined.select(
        "column",
        "inferred_type",
        "null_count",
        _percentage("null_count").alias("null_percentage"),
        "distinct_count",
        _ratio().alias("cardinality_ratio"),
        _unique(),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        *[F.when(is_number, round2(F.col(s)).cast("double")).alias(s) for s in STAT_COLUMNS],
        F.when(is_date, F.col("min_date")).alias("min_date"),
        F.when(is_date, F.col("max_date")).alias("max_date"),
        F.when(kind == "categorical", F.col("top_frequencies")).alias("top_frequencies"),
        F.coalesce(F.col("value_count") - parsed, F.lit(0)).alias("parse_failures"),
    )


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def text_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_text(df, c)]
