"""Data quality issues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.dates import (
    DASH_LAYOUT,
    SLASH_LAYOUT,
    first_part_over_12,
    to_iso_date,
)
from shelfwise.functions.numbers import CURRENCY_ANY, looks_like_currency, to_number
from shelfwise.functions.text import name_col, strip
from shelfwise.operators.dedup import duplicate_keys
from shelfwise.operators.frequency import duplicate_groups, per_column, value_counts
from shelfwise.operators.profiling import BOOLEAN_WORDS, is_text
from shelfwise.operators.shapes import shape_counts
from shelfwise.operators.variants import (
    SUSPECT_RATIO,
    case_variants,
    similar_keys,
)
from shelfwise.roles import has_role, key_columns

ISSUE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("issue_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("sample_values", T.ArrayType(T.StringType())),
        T.StructField("affected_count", T.LongType()),
    ]
)

# Fixed values.
MAX_CATEGORIES = 50
SAMPLES = 3
MIN_PARSE_RATIO = 0.9



def least_samples(found: DataFrame, by: Sequence[str], value: str, k: int | None = SAMPLES) -> DataFrame:
    """(by..., sample_values): the k smallest distinct values of each group, all with None.

    Distinct values are combined and ranked before the shuffle as well, so a
    task sends at most k values of a group.
    """
    distinct = found.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__value")).distinct()
    if k is not None:
        order = Window.partitionBy(*by).orderBy("__value")
        distinct = distinct.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k)
    return distinct.groupBy(*by).agg(F.array_sort(F.collect_list("__value")).alias("sample_values"))


# The rule of each kind of flagged text; order_date-like names only for dates.
FLAGS = {
    "whitespace": lambda c: c != strip(c),
    "currency_formats": lambda c: c.rlike(CURRENCY_ANY),
    "inconsistent_dates": lambda c: c.rlike(SLASH_LAYOUT),
}


def flagged_samples(df: DataFrame, wanted: Sequence[tuple[str, str]], k: int | None = SAMPLES) -> DataFrame:
    """(column, kind, sample_values) of flagged text, for pairs of column and kind, from one scan."""
    flagged = [
        F.struct(
            F.lit(column).alias("column"), F.lit(kind).alias("kind"),
            F.when(FLAGS[kind](name_col(column)), name_col(column)).alias("value"),
        )
        for column, kind in wanted
    ]
    if not flagged:
        return df.sparkSession.createDataFrame([], "column string, kind string, sample_values array<string>")
    return least_samples(df.select(F.inline(F.array(*flagged))), ["column", "kind"], "value", k)


def issue_signals(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column with all counts the column rules need, from its value shapes."""
    columns = list(df.columns if columns is None else columns)
    text = [c for c in columns if is_text(df, c)]
    dates = [c for c in text if has_role(c, "issue_date")]
    counted = shape_counts(df, columns, text, dates)
    c, n = F.col("shape"), F.col("n")
    dated, named = F.col("column").isin(dates or [""]), F.col("column").isin(text or [""])
    trimmed, no = strip(c), F.lit(False)
    # Tests that others need come first, so that each is made once per shape.
    shapes = counted.select("column", "shape", "n", "binary").withColumns({
        "trimmed": trimmed, "digit": named & c.rlike(r"\d"), "money": named & c.rlike(CURRENCY_ANY),
    })
    digit, money, trimmed = F.col("digit"), F.col("money"), F.col("trimmed")
    # 0 and 1 are truth words too; a shape does not tell them from other digits.
    word = named & F.lower(trimmed).isin(*[w for w in BOOLEAN_WORDS if not w.isdigit()])
    flags = {
        "value_count": c.isNotNull(),
        "padded_count": named & (c != trimmed),
        "currency_count": money,
        "number_count": digit & to_number(c).isNotNull(),
        "dash_count": dated & digit & c.rlike(DASH_LAYOUT),
        "slash_count": dated & digit & c.rlike(SLASH_LAYOUT),
        "date_count": F.when(dated & digit, to_iso_date(trimmed).isNotNull()),
    }
    tested = shapes.select(
        "column", "n", "binary", word.alias("word"), (money & looks_like_currency(c)).alias("has_currency"),
        F.when(dated & digit, first_part_over_12(trimmed)).alias("day_first"), *[f.alias(k) for k, f in flags.items()],
    )

    def rows(flag):
        return F.coalesce(F.sum(F.when(F.col(flag), n)), F.lit(0).cast("bigint"))

    return tested.groupBy("column").agg(
        F.sum("n").alias("row_count"),
        rows("value_count").alias("value_count"),
        rows("padded_count").alias("padded_count"),
        F.coalesce(F.bool_or("has_currency"), no).alias("has_currency"),
        rows("currency_count").alias("currency_count"),
        (rows("word") + F.sum("binary")).alias("boolean_count"),
        *[rows(k).alias(k) for k in ("number_count", "dash_count", "slash_count")],
        F.coalesce(F.bool_or("day_first"), no).alias("day_first"),
        rows("date_count").alias("date_count"),
    ).select(
        "column", named.alias("is_text"),
        "row_count", "value_count", "padded_count", "has_currency", "currency_count", "boolean_count", "number_count",
        "dash_count", "slash_count", "day_first", "date_count",
    )


def _counted_samples(groups: DataFrame) -> DataFrame:
    """One row: repeated rows of (n, shown) groups and the least of what they show."""
    samples = least_samples(groups.withColumn("all", F.lit(1)), ["all"], "shown")
    total = groups.agg(F.sum(F.col("n") - 1).alias("affected_count")).withColumn("all", F.lit(1))
    # One row on each side.
    return total.join(F.broadcast(samples), "all", "left")


def duplicate_row_issue(df: DataFrame, dataset: str) -> DataFrame:
    found = _counted_samples(duplicate_groups(df).select("n", F.to_json("row").alias("shown")))
    return _issue_frame(
        found,
        F.lit(f"{dataset}_issue_duplicate_rows"),
        F.lit(None),
        "duplicate_records",
        "medium",
        F.format_string("%d rows repeat an earlier row in every column.", "affected_count"),
    )


def duplicate_key_issue(df: DataFrame, dataset: str, keys: Sequence[str]) -> DataFrame:
    field = ",".join(keys)
    shown = F.concat_ws(",", *[name_col(k).cast("string") for k in keys])
    found = _counted_samples(duplicate_keys(df, keys).select("n", shown.alias("shown")))
    return _issue_frame(
        found,
        F.lit(f"{dataset}_{field}_duplicate_keys"),
        F.lit(field),
        "duplicate_records",
        "high",
        F.format_string(f"%d rows repeat a key of '{field}'.", "affected_count"),
    )


def category_counts(
    df: DataFrame, columns: Sequence[str], max_categories: int | None = MAX_CATEGORIES
) -> DataFrame:
    """Value counts of those columns that have at most ``max_categories``
    distinct values, exactly counted; of all columns with None."""
    counts = value_counts(df, columns)
    if max_categories is None:
        return counts
    few = counts.groupBy("column").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") <= max_categories)
    return counts.join(F.broadcast(few), "column", "left_semi")


def case_variant_issues(counts: DataFrame, dataset: str) -> DataFrame:
    """Columns with values that differ in case only, with the first five spellings."""
    keys = case_variants(counts)
    spelled = keys.select("column", F.explode("variants").alias("variant"))
    found = keys.groupBy("column").agg(F.count(F.lit(1)).alias("affected_count")).join(
        F.broadcast(least_samples(spelled, ["column"], "variant", 5)), "column"
    )
    return _issue_frame(
        found,
        F.concat(F.lit(f"{dataset}_"), "column", F.lit("_inconsistent_case")),
        F.col("column"),
        "whitespace_case",
        "low",
        F.format_string("'%s' spells %d values with different letter case.", "column", "affected_count"),
    )


def suspicious_pairs(counts: DataFrame, measure: str = "blocks") -> DataFrame:
    """(column, a, b, ratio) of lower-cased values that look like typos."""
    trimmed = F.lower(strip(F.col("value")))
    keys = counts.select(F.col("column").alias("grp"), trimmed.alias("key")).where("key <> ''").distinct()
    pairs = similar_keys(keys, SUSPECT_RATIO, measure=measure)
    return pairs.where("ratio < 1").withColumnRenamed("grp", "column")


def near_duplicate_issues(counts: DataFrame, dataset: str, measure: str = "blocks") -> DataFrame:
    shown = F.concat("a", F.lit(" ~ "), "b", F.lit(" (sim: "), F.round("ratio", 2), F.lit(")"))
    pairs = suspicious_pairs(counts, measure).withColumn("shown", shown)
    found = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("affected_count")).join(
        F.broadcast(least_samples(pairs, ["column"], "shown")), "column"
    )
    return _issue_frame(
        found,
        F.concat(F.lit(f"{dataset}_"), "column", F.lit("_suspicious_categories")),
        F.col("column"),
        "suspicious_categories",
        "medium",
        F.format_string("'%s' has %d pairs of nearly equal categories.", "column", "affected_count"),
    )


def mixed_type_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns where some values are numbers and some are not."""
    columns = [c for c in df.columns if is_text(df, c)] if columns is None else list(columns)

    def aggregate(column, v):
        return {"value_count": F.count(v["v"]), "number_count": F.count(v["x"])}

    counted = per_column(
        df, columns, lambda c: {"v": name_col(c), "x": to_number(name_col(c))}, aggregate
    )
    return counted.where("number_count > 0 AND number_count < value_count").select(
        "column", "number_count", (F.col("value_count") - F.col("number_count")).alias("other_count")
    )


def _issue_frame(found, issue_id, field, issue_type, severity, description) -> DataFrame:
    return found.where("affected_count > 0").select(
        issue_id.alias("id"),
        field.cast("string").alias("field"),
        F.lit(issue_type).alias("issue_type"),
        F.lit(severity).alias("severity"),
        description.alias("description"),
        F.col("sample_values"),
        F.col("affected_count").cast("bigint").alias("affected_count"),
    )


def currency_flagged(signal: Row, min_parse_ratio: float = MIN_PARSE_RATIO) -> bool:
    """A comma alone is no money: most values must parse as numbers."""
    return signal["has_currency"] and (
        signal["number_count"] >= min_parse_ratio * signal["value_count"]
    )


def column_issues(
    df: DataFrame, signals: Sequence[Row], dataset: str, min_parse_ratio: float = MIN_PARSE_RATIO
) -> DataFrame:
    """Issues that follow from the signals, with samples of the flagged text."""
    rows = []

    def add(signal, suffix, issue_type, severity, count, description):
        column = signal["column"]
        rows.append((f"{dataset}_{column}_{suffix}", column, issue_type, severity, description, suffix, count))

    for s in signals:
        column = s["column"]
        if s["value_count"] == 0:
            if s["row_count"]:
                add(s, "all_null", "missing_values", "high", s["row_count"],
                    f"'{column}' holds no value at all.")
            continue
        if s["padded_count"]:
            add(s, "whitespace", "whitespace_case", "low", s["padded_count"],
                f"{s['padded_count']} values of '{column}' start or end with white space.")
        if currency_flagged(s, min_parse_ratio):
            add(s, "currency_formats", "currency_formats", "medium", s["currency_count"],
                f"'{column}' holds money or grouped numbers as text.")
        if s["dash_count"] and s["slash_count"]:
            add(s, "inconsistent_dates", "inconsistent_dates", "high", s["slash_count"],
                f"'{column}' mixes dates with dashes and dates with slashes.")
    spark = df.sparkSession
    found = spark.createDataFrame(
        rows, "id string, field string, issue_type string, severity string, description string, kind string, "
        "affected_count long",
    )
    samples = flagged_samples(df, [(r[1], r[5]) for r in rows if r[5] in FLAGS])
    # A few rows per column on either side.
    joined = found.join(
        F.broadcast(samples.withColumnRenamed("column", "field")), ["field", "kind"], "left"
    )
    return joined.select(
        *[
            F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values")
            if f.name == "sample_values" else F.col(f.name)
            for f in ISSUE_SCHEMA.fields
        ]
    )


def category_candidates(signals: Sequence[Row]) -> list[str]:
    """Text columns that may be categories: no identifier, boolean, number or date."""
    names = []
    for s in signals:
        n = s["value_count"]
        other_type = n in (s["boolean_count"], s["number_count"], s["date_count"])
        if n >= 2 and not other_type and s["is_text"] and not has_role(s["column"], "identifier"):
            names.append(s["column"])
    return names


def detect_issues(
    df: DataFrame,
    dataset: str,
    keys: Mapping[str, tuple[str, ...]] | None = None,
    min_parse_ratio: float = MIN_PARSE_RATIO,
    measure: str = "blocks",
    signals: Sequence[Row] | None = None,
    max_categories: int | None = MAX_CATEGORIES,
) -> DataFrame:
    """All issues of a table. Runs one small job for the column signals.

    Case and spelling are checked in columns of at most ``max_categories``
    distinct values, in all text columns with None.
    """
    if signals is None:
        signals = issue_signals(df).collect()  # one row per column
    parts = [column_issues(df, signals, dataset, min_parse_ratio), duplicate_row_issue(df, dataset)]
    candidates = category_candidates(signals)
    if candidates:
        counts = category_counts(df, candidates, max_categories)
        parts.append(case_variant_issues(counts, dataset))
        parts.append(near_duplicate_issues(counts, dataset, measure))
    for key in key_columns(dataset, df.columns, keys):
        parts.append(duplicate_key_issue(df, dataset, key))
    return reduce(DataFrame.unionByName, parts)
