"""Filter predicates, aggregates, sorting and limits of declarative queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.numbers import is_numeric, number_of
from shelfwise.functions.text import name_col, round2

# Fixed values.
OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "contains", "is_null", "not_null")
OPERATOR_ALIASES = {
    "==": "eq", "=": "eq", "equals": "eq", "!=": "neq", "<>": "neq",
    ">": "gt", ">=": "gte", "<": "lt", "<=": "lte",
}
AGGREGATIONS = ("sum", "avg", "min", "max", "count", "count_distinct")
AGGREGATION_ALIASES = {
    "average": "avg", "mean": "avg", "distinct_count": "count_distinct",
    "unique": "count_distinct", "total": "sum",
}
DEFAULT_LIMIT = 10
MAX_LIMIT = 100


def _is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _equal(df: DataFrame, field: str, value) -> Column:
    """Text is compared without case; a value of another type than the column
    equals nothing."""
    c, kind = name_col(field), df.schema[field].dataType
    if isinstance(value, str):
        return F.lower(c.cast("string")) == value.lower()
    if isinstance(value, bool):
        return c == value if isinstance(kind, T.BooleanType) else F.lit(False)
    if _is_number(value) and is_numeric(kind):
        return c == value
    return F.lit(False)


def _literal(df: DataFrame, field: str, value) -> Column:
    """The number in the column's own type where that loses nothing, so that
    the comparison reaches the scan as a pushed filter."""
    number = float(value)
    if isinstance(df.schema[field].dataType, T.IntegralType) and number.is_integer():
        return F.lit(int(number))
    if isinstance(df.schema[field].dataType, T.DecimalType):
        return F.lit(Decimal(str(value)))
    return F.lit(number)


def predicate(df: DataFrame, field: str, op: str, value=None, regex: bool = False) -> Column:
    """One filter as a column. Nulls match only ``neq`` and ``is_null``."""
    op = OPERATOR_ALIASES.get(op, op)
    if op not in OPERATORS:
        raise ValueError(f"unknown operator '{op}' in a filter")
    if field not in df.columns:
        raise ValueError(f"filtered column '{field}' does not exist in schema")
    c = name_col(field)
    if op == "is_null":
        return c.isNull()
    if op == "not_null":
        return c.isNotNull()
    if op == "eq":
        return _equal(df, field, value)
    if op == "neq":
        return ~F.coalesce(_equal(df, field, value), F.lit(False))
    if op == "in":
        if not isinstance(value, (list, tuple, set)):
            return _equal(df, field, value)
        values = list(value)
        if values and is_numeric(df.schema[field].dataType) and all(map(_is_number, values)):
            return c.isin(values)
        return F.lower(c.cast("string")).isin([str(v).lower() for v in values])
    if op == "contains":
        text = c.cast("string")
        if regex:
            return text.rlike("(?i)" + str(value))
        return F.lower(text).contains(str(value).lower())
    kind = df.schema[field].dataType
    number = c if is_numeric(kind) else number_of(df, field)
    limit = _literal(df, field, value)
    test = {
        "gt": number > limit, "gte": number >= limit, "lt": number < limit, "lte": number <= limit,
    }[op]
    if isinstance(kind, (T.FloatType, T.DoubleType)) and op in ("gt", "gte"):
        # NaN is greater than everything in Spark, and no number here. The
        # comparison itself stays plain, so that it is still pushed down.
        test = test & ~F.isnan(c)
    return test


def filter_funnel(df: DataFrame, filters: Sequence[Mapping]) -> DataFrame:
    """(step, filter, remaining): rows left after each filter, from one scan."""
    kept, passed = F.lit(True), [F.count(F.lit(1)).alias("s0")]
    for i, f in enumerate(filters, 1):
        test = predicate(df, f["field"], f["op"], f.get("value"), f.get("regex", False))
        kept = kept & F.coalesce(test, F.lit(False))
        passed.append(F.count_if(kept).alias(f"s{i}"))
    labels = ["all rows"] + [f"{f['field']} {f['op']} {f.get('value')}" for f in filters]
    steps = [
        F.struct(F.lit(i).alias("step"), F.lit(label).alias("filter"), F.col(f"s{i}").alias("remaining"))
        for i, label in enumerate(labels)
    ]
    return df.agg(*passed).select(F.inline(F.array(*steps)))


def metric(df: DataFrame, agg: str, field: str) -> Column:
    """One aggregate. Sums take unparseable values as 0, the others skip them."""
    agg = AGGREGATION_ALIASES.get(agg, agg)
    if agg not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation '{agg}'")
    if field == "*":
        if agg != "count":
            raise ValueError(f"'{agg}' of all rows has no meaning; name a column")
        return F.count(F.lit(1))
    if field not in df.columns:
        raise ValueError(f"aggregated column '{field}' does not exist in schema")
    c = name_col(field)
    if agg == "count":
        return F.count(c)
    if agg == "count_distinct":
        return F.count_distinct(c)
    kind = df.schema[field].dataType
    exact = isinstance(kind, T.DecimalType)
    number = c if exact else number_of(df, field)
    if isinstance(kind, T.IntegralType):
        number = c.cast("decimal(20,0)")
    if agg == "sum":
        total = F.coalesce(F.sum(number), F.lit(0))
        return total.cast("double") if not exact else total
    result = {"avg": F.avg, "min": F.min, "max": F.max}[agg](number)
    return result.cast("double") if not exact else result


def metric_name(agg: str, field: str, alias: str | None = None) -> str:
    return alias or f"{AGGREGATION_ALIASES.get(agg, agg)}_{field}"


def grouped(
    df: DataFrame,
    group_by: Sequence[str],
    metrics: Sequence[Mapping],
    keep_null_groups: bool = False,
) -> DataFrame:
    """Grouped metrics, each independent of the others. Without metrics, the
    distinct keys with nulls kept; with metrics, groups with a null key are
    dropped unless asked for."""
    keys = [name_col(g) for g in group_by]
    if not metrics:
        return df.select(*keys).distinct()
    if not keep_null_groups:
        for key in keys:
            df = df.where(key.isNotNull())
    return df.groupBy(*keys).agg(
        *[
            metric(df, m["agg"], m["field"]).alias(metric_name(m["agg"], m["field"], m.get("alias")))
            for m in metrics
        ]
    )


def total(df: DataFrame, m: Mapping) -> Column:
    """One global metric at two decimals; without rows sum and average are 0."""
    agg = AGGREGATION_ALIASES.get(m["agg"], m["agg"])
    value = metric(df, agg, m["field"])
    if agg in ("avg", "sum"):
        value = F.coalesce(value, F.lit(0.0))
    if agg in ("avg", "sum", "min", "max"):
        value = round2(value).cast("double")
    return value.alias(metric_name(agg, m["field"], m.get("alias")))


def totals(df: DataFrame, metrics: Sequence[Mapping]) -> DataFrame:
    return df.agg(*[total(df, m) for m in metrics])


def clamp_limit(limit: int) -> int:
    """A limit between 1 and MAX_LIMIT, for callers that show results."""
    return DEFAULT_LIMIT if limit <= 0 else min(limit, MAX_LIMIT)


def sort_columns(df: DataFrame, sort: Sequence[Mapping], ties: bool = True) -> list[Column]:
    """Sort keys with nulls last both ways. Unknown fields are ignored, an
    unknown direction is descending, and the other columns break ties."""
    keys, used = [], set()
    for s in sort:
        if s["field"] in df.columns:
            c = name_col(s["field"])
            up = str(s.get("dir", "desc")).lower() == "asc"
            keys.append(c.asc_nulls_last() if up else c.desc_nulls_last())
            used.add(s["field"])
    if ties and keys:
        orderable = [
            f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)
        ]
        keys += [name_col(c).asc_nulls_last() for c in orderable if c not in used]
    return keys


def find_value(df: DataFrame, phrase: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, rows): every distinct text value that holds ``phrase``, compared without case.

    All text columns are searched in one scan; matches are counted per value
    before the shuffle. Columns stand in the order of the table, values in that
    of their text.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    names = [c for c in names if columns is None or c in columns]
    if not names or not phrase:
        return df.sparkSession.createDataFrame([], "column string, value string, rows long")
    wanted = phrase.lower()
    found = [
        F.struct(
            F.lit(i).alias("place"), F.lit(c).alias("column"),
            F.when(F.contains(F.lower(name_col(c)), F.lit(wanted)), name_col(c)).alias("value"),
        )
        for i, c in enumerate(names)
    ]
    return (
        df.select(F.inline(F.array(*found))).where("value IS NOT NULL")
        .groupBy("place", "column", "value").agg(F.count(F.lit(1)).alias("rows"))
        .orderBy("place", "value").select("column", "value", "rows")
    )
