"""A query given as a description: join, filter, group, sort, limit.

The description is a plain dict with the keys dataset, joins, filters,
group_by, metrics, sort and limit. It becomes DataFrame calls; Catalyst does
the planning. Beside the result there is an evidence row.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.text import name_col
from shelfwise.operators.filters import (
    AGGREGATION_ALIASES,
    AGGREGATIONS,
    MAX_LIMIT,
    OPERATOR_ALIASES,
    OPERATORS,
    grouped,
    metric,
    metric_name,
    predicate,
    sort_columns,
    total,
    totals,
)
from shelfwise.operators.joins import JOIN_TYPES, join_diagnostics, key_join
from shelfwise.session import stage
from shelfwise.sources.tables import presentable

# A metric with one of these in its name is shown as money.
MONEY_NAME_PARTS = ("rev", "sale", "price", "amount", "cost")
# The type of ``joins`` where there is none.
JOINS = (
    "array<struct<dataset: string, left_on: string, right_on: string, how: string, rows_left: bigint, "
    "rows_right: bigint, rows_joined: decimal(38,0), fanout_ratio: double, fanout_warning: boolean>>"
)
# The sentences of an answer.
SCALAR_ANSWER = "Based on dataset **{dataset}** (%d rows evaluated), the computed **{name}** is **%s**."
ONE_RECORD = "Found matching record in **{dataset}**: **%s** (%s)."
MANY_RECORDS = (
    "Found %d matching record(s) in **{dataset}** (%d rows evaluated). Showing records below."
)
TOP_RECORD = (
    "In **{dataset}** across %d records, **%s** ranked highest with **%s** in {name}. "
    "Showing top %d records below."
)
NO_RECORDS = "No records matched the query criteria in dataset **{dataset}**."


def check_spec(tables: Mapping[str, DataFrame], spec: Mapping) -> None:
    """Raise one ValueError that lists everything wrong with a description."""
    name = spec.get("dataset")
    if name not in tables:
        raise ValueError(f"dataset '{name}' is not loaded")
    errors = []
    known = set(tables[name].columns)
    for j in spec.get("joins", []):
        if j["dataset"] not in tables:
            errors.append(f"join dataset '{j['dataset']}' is not loaded")
            continue
        right = set(tables[j["dataset"]].columns)
        if j["left_on"] not in known:
            errors.append(f"join key '{j['left_on']}' does not exist in schema")
        if j["right_on"] not in right:
            errors.append(f"join key '{j['right_on']}' does not exist in '{j['dataset']}'")
        if j.get("how", "inner") not in JOIN_TYPES:
            errors.append(f"join type '{j['how']}' is not allowed")
        known |= right | {f"{c}_{j['dataset']}" for c in right & known}
    for f in spec.get("filters", []):
        if f["field"] not in known:
            errors.append(f"filter field '{f['field']}' does not exist in schema")
        if OPERATOR_ALIASES.get(f["op"], f["op"]) not in OPERATORS:
            errors.append(f"operator '{f['op']}' is not allowed in a filter")
    for g in spec.get("group_by", []):
        if g not in known:
            errors.append(f"group field '{g}' does not exist in schema")
    aliases = set()
    for m in spec.get("metrics", []):
        if AGGREGATION_ALIASES.get(m["agg"], m["agg"]) not in AGGREGATIONS:
            errors.append(f"aggregation '{m['agg']}' is not allowed")
        if m["field"] != "*" and m["field"] not in known:
            errors.append(f"metric field '{m['field']}' does not exist in schema")
        aliases |= {metric_name(m["agg"], m["field"], m.get("alias")), m["field"]}
    for s in spec.get("sort", []):
        if s["field"] not in known | aliases:
            errors.append(f"sort field '{s['field']}' does not exist in schema")
    if errors:
        raise ValueError("; ".join(errors))


def intent_of(spec: Mapping) -> str:
    return "aggregate" if spec.get("metrics") or spec.get("group_by") else "filter"


def joined_table(tables: Mapping[str, DataFrame], spec: Mapping) -> DataFrame:
    df = tables[spec["dataset"]]
    for j in spec.get("joins", []):
        df = key_join(
            df, tables[j["dataset"]], j["left_on"], j["right_on"], j.get("how", "inner"),
            right_name=j["dataset"], left_name=spec["dataset"],
        )
    return df


def _tests(df: DataFrame, spec: Mapping) -> list[Column]:
    return [
        predicate(df, f["field"], f["op"], f.get("value"), f.get("regex", False))
        for f in spec.get("filters", [])
    ]


def considered_rows(tables: Mapping[str, DataFrame], spec: Mapping) -> DataFrame:
    df = joined_table(tables, spec)
    return reduce(DataFrame.where, _tests(df, spec), df)


def _result(df: DataFrame, spec: Mapping) -> DataFrame:
    metrics, groups = spec.get("metrics", []), spec.get("group_by", [])
    if groups:
        return grouped(df, groups, metrics, spec.get("keep_null_groups", False))
    return totals(df, metrics) if metrics else df


def _finished(result: DataFrame, spec: Mapping) -> DataFrame:
    """Sorted, cut to the limit, floats at two decimals."""
    keys = sort_columns(result, spec.get("sort", []))
    if not keys:
        keys = [name_col(g).asc_nulls_last() for g in spec.get("group_by", [])]
    if keys:
        result = result.orderBy(*keys)
    if spec.get("limit") is not None:
        result = result.limit(int(spec["limit"]))
    return result.select(*[presentable(result, c) for c in result.columns])


def run_query(tables: Mapping[str, DataFrame], spec: Mapping) -> DataFrame:
    """The sorted result, floats at two decimals: all rows, or as many as ``limit`` says.

    ``filters.clamp_limit`` bounds a limit for callers that want one bounded.
    """
    check_spec(tables, spec)
    return _finished(_result(considered_rows(tables, spec), spec), spec)


def columns_used(spec: Mapping) -> list[str]:
    used = {f["field"] for f in spec.get("filters", [])} | set(spec.get("group_by", []))
    used |= {m["field"] for m in spec.get("metrics", [])}
    for j in spec.get("joins", []):
        used |= {j["left_on"], j["right_on"]}
    return sorted(used)


def _counted_result(current: DataFrame, spec: Mapping) -> tuple[DataFrame, DataFrame]:
    """The result, and one row of counts: loaded, filter0, ..., considered, returned.

    Both come out of one pass over the joined rows: one aggregate per group
    carries the counts beside the metrics, with the rows that pass all filters
    apart from those that do not. Its rows, two per group at most, are staged.
    A result of plain rows is aggregated by nothing, so it takes a second pass.
    """
    groups, metrics = spec.get("group_by", []), spec.get("metrics", [])
    kept, counts = F.lit(True), {"loaded": F.lit(True)}
    for i, test in enumerate(_tests(current, spec)):
        kept = kept & F.coalesce(test, F.lit(False))
        counts[f"filter{i}"] = kept
    counts["considered"] = kept
    counting = [F.count_if(c).alias(f"__{n}") for n, c in counts.items()]
    if not groups and not metrics:
        facts = current.agg(*[c.alias(n) for n, c in zip(counts, counting)]).withColumn("returned", F.col("considered"))
        return _finished(reduce(DataFrame.where, _tests(current, spec), current), spec), _limited(facts, spec)
    measure = (lambda m: metric(current, m["agg"], m["field"])) if groups else (lambda m: total(current, m))
    both = stage(
        current.groupBy(*[name_col(g).alias(f"__g{i}") for i, g in enumerate(groups)], kept.alias("__kept"))
        .agg(*counting, *[measure(m).alias(f"__m{i}") for i, m in enumerate(metrics)]),
        "query-groups",
    )
    keys = [F.col(f"__g{i}") for i in range(len(groups))]
    seen = F.col("__kept")
    if metrics and not spec.get("keep_null_groups", False):
        seen = reduce(Column.__and__, [k.isNotNull() for k in keys], seen)
    rows = both.where(seen)
    names = [metric_name(m["agg"], m["field"], m.get("alias")) for m in metrics]
    rows = rows.select(
        *[k.alias(g) for k, g in zip(keys, groups)], *[F.col(f"__m{i}").alias(n) for i, n in enumerate(names)]
    )
    if not groups and rows.isEmpty():
        rows = totals(current.where("false"), metrics)  # no row passed: nothing is read
    returned = F.count_if(seen) if groups else F.lit(1).cast("bigint")
    facts = both.agg(*[F.coalesce(F.sum(f"__{n}"), F.lit(0)).alias(n) for n in counts], returned.alias("returned"))
    return _finished(rows, spec), _limited(facts, spec)


def _limited(facts: DataFrame, spec: Mapping) -> DataFrame:
    if spec.get("limit") is None:
        return facts
    return facts.withColumn("returned", F.least("returned", F.lit(int(spec["limit"])).cast("bigint")))


def evidence(tables: Mapping[str, DataFrame], spec: Mapping) -> DataFrame:
    """One row that tells what the query read, did and found.

    Row counts and the result come from one pass over the joined rows, join
    sizes from key counts; the steps are not run one by one. One job runs, which
    keeps the aggregated groups. ``joins`` holds the diagnostics
    with their warning, ``preview`` the first rows of the result as JSON, at
    most ``MAX_LIMIT``, and ``scalar_answer`` the value of a single metric.
    """
    check_spec(tables, spec)
    dataset = spec["dataset"]
    base = tables[dataset]
    joins, filters = spec.get("joins", []), spec.get("filters", [])
    facts: list[DataFrame] = []
    current = base
    for i, j in enumerate(joins):
        how = j.get("how", "inner")
        found = join_diagnostics(current, tables[j["dataset"]], j["left_on"], j["right_on"], how)
        facts.append(found.select(*[F.col(c).cast("string").alias(f"{c}{i}") for c in found.columns]))
        current = key_join(current, tables[j["dataset"]], j["left_on"], j["right_on"], how,
                           right_name=j["dataset"])
    result, counted = _counted_result(current, spec)
    facts.append(counted.select(*[F.col(c).cast("string").alias(c) for c in counted.columns]))
    metrics = spec.get("metrics", [])
    scalar = len(metrics) == 1 and not spec.get("group_by")
    row = F.to_json(F.struct(*[name_col(c) for c in result.columns]), {"ignoreNullFields": "false"})
    # At most MAX_LIMIT rows; numbered as they come, since the limit keeps their order.
    shown = result.limit(MAX_LIMIT).select(row.alias("row")).withColumn("at", F.monotonically_increasing_id())
    shown = shown.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("at", "row"))), lambda r: r["row"])).alias("preview"))
    if scalar:
        name = metric_name(metrics[0]["agg"], metrics[0]["field"], metrics[0].get("alias"))
        facts.append(result.select(shown_text(result, name).alias("scalar")))
    facts.append(shown)

    # All facts are single rows; they meet as (name, value) pairs in one map.
    pairs = [
        f.select(F.inline(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in f.columns])))
        for f in facts
    ]
    one = reduce(DataFrame.unionByName, pairs).agg(
        F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m")
    )

    def fact(name):
        return F.col("m")[name]

    operations = [F.format_string(f"LOAD {dataset} (%s rows)", fact("rows_left0" if joins else "loaded"))]
    performed = []
    for i, j in enumerate(joins):
        text = f"JOIN {j['dataset']} ON {j['left_on']} = {j['right_on']} (%s rows, fan-out %sx)"
        operations.append(F.format_string(text, fact(f"rows_joined{i}"), fact(f"fanout_ratio{i}")))
        performed.append(
            F.struct(
                F.lit(j["dataset"]).alias("dataset"), F.lit(j["left_on"]).alias("left_on"),
                F.lit(j["right_on"]).alias("right_on"), F.lit(j.get("how", "inner")).alias("how"),
                *[
                    fact(f"{c}{i}").cast(kind).alias(c)
                    for c, kind in (
                        ("rows_left", "bigint"), ("rows_right", "bigint"), ("rows_joined", "decimal(38,0)"),
                        ("fanout_ratio", "double"), ("fanout_warning", "boolean"),
                    )
                ],
            )
        )
    for i, f in enumerate(filters):
        shown_value = str(f.get("value")).replace("%", "%%")
        text = f"FILTER {f['field']} {f['op']} {shown_value} (%s rows left)"
        operations.append(F.format_string(text, fact(f"filter{i}")))
    names = [metric_name(m["agg"], m["field"], m.get("alias")) for m in metrics]
    if spec.get("group_by"):
        operations.append(F.lit(f"GROUP BY {', '.join(spec['group_by'])} [{', '.join(names)}]"))
    elif names:
        operations.append(F.lit(f"AGGREGATE [{', '.join(names)}]"))
    if spec.get("sort"):
        operations.append(
            F.lit("SORT BY " + ", ".join(f"{s['field']} {s.get('dir', 'desc')}" for s in spec["sort"]))
        )
    limit = "LIMIT none" if spec.get("limit") is None else f"LIMIT {int(spec['limit'])}"
    operations.append(F.format_string(f"{limit} (%s rows returned)", fact("returned")))

    def texts(values):
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return one.select(
        F.lit(dataset).alias("dataset"),
        texts(columns_used(spec)).alias("columns_used"),
        texts([f"{f['field']} {f['op']} {f.get('value')}" for f in filters]).alias("filters"),
        (F.array(*performed) if performed else F.array().cast(JOINS)).alias("joins"),
        F.array(*operations).alias("operations"),
        fact("considered").cast("bigint").alias("rows_considered"),
        fact("returned").cast("bigint").alias("rows_returned"),
        F.from_json(fact("preview"), "array<string>").alias("preview"),
        (fact("scalar") if scalar else F.lit(None).cast("string")).alias("scalar_answer"),
    )


def shown_text(df: DataFrame, column: str) -> Column:
    """A value as text; floats without exponent and at least one decimal."""
    c = name_col(column)
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return F.regexp_replace(c.cast("decimal(38,2)").cast("string"), "0$", "")
    return c.cast("string")


def answer_text(tables: Mapping[str, DataFrame], spec: Mapping) -> DataFrame:
    """(answer_type, summary): a scalar, the top row of a table, or no records."""
    check_spec(tables, spec)
    metrics = spec.get("metrics", [])
    if len(metrics) == 1 and not spec.get("group_by"):
        return _scalar_answer(considered_rows(tables, spec), spec["dataset"], metrics[0])
    return _table_answer(tables, spec)


def _scalar_answer(rows: DataFrame, dataset: str, m: Mapping) -> DataFrame:
    name = metric_name(m["agg"], m["field"], m.get("alias"))
    found = rows.agg(F.count(F.lit(1)).alias("considered"), total(rows, m).alias("value"))
    if any(part in name.lower() for part in MONEY_NAME_PARTS):
        shown = F.concat(F.lit("$"), F.format_number(F.col("value").cast("decimal(38,2)"), 2))
    elif isinstance(found.schema["value"].dataType, T.LongType):
        shown = F.format_number("value", 0)
    else:
        shown = shown_text(found, "value")
    missing = F.col("value").isNull()
    none = F.lit("None")
    return found.select(
        F.when(missing, "table").otherwise("scalar").alias("answer_type"),
        F.when(
            missing,
            F.format_string(
                TOP_RECORD.format(dataset=dataset, name=name), "considered", none, none, F.lit(1)
            ),
        )
        .otherwise(
            F.format_string(SCALAR_ANSWER.format(dataset=dataset, name=name), "considered", shown)
        )
        .alias("summary"),
    )


def _table_answer(tables: Mapping[str, DataFrame], spec: Mapping) -> DataFrame:
    dataset, groups = spec["dataset"], spec.get("group_by", [])
    result, counts = _counted_result(joined_table(tables, spec), spec)
    names = result.columns
    # One row of the order of the query, and the counts from one pass.
    first = result.limit(1).select(F.struct(*[shown_text(result, c).alias(f"c{i}") for i, c in enumerate(names)]).alias("top"))
    counts = counts.select("considered", F.col("returned").alias("shown"))
    facts = first.unionByName(counts, allowMissingColumns=True).agg(
        F.max("shown").alias("shown"),
        F.first("top", ignorenulls=True).alias("top"),
        F.max("considered").alias("considered"),
    )

    def value(column):
        return F.coalesce(F.col(f"top.c{names.index(column)}"), F.lit("None"))

    label = groups[0] if groups else names[0]
    if intent_of(spec) == "filter":
        details = [
            F.concat(F.lit(f"**{c}**: "), F.col(f"top.c{i}"))
            for i, c in enumerate(names)
            if c != label
        ]
        listed = F.array_join(F.slice(F.array_compact(F.array(*details)), 1, 4), ", ")
        one = F.format_string(ONE_RECORD.format(dataset=dataset), value(label), listed)
        many = F.format_string(MANY_RECORDS.format(dataset=dataset), "shown", "considered")
        text = F.when(F.col("shown") == 1, one).otherwise(many)
    else:
        measured = next((c for c in names if c not in groups), None)
        text = F.format_string(
            TOP_RECORD.format(dataset=dataset, name=measured or "the metric"),
            "considered",
            value(label),
            value(measured) if measured else F.lit(""),
            "shown",
        )
    empty = F.col("shown") == 0
    return facts.select(
        F.when(empty, "empty_result").otherwise("table").alias("answer_type"),
        F.when(empty, NO_RECORDS.format(dataset=dataset)).otherwise(text).alias("summary"),
    )
