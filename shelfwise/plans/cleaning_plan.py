"""From issues to cleaning steps, and the steps applied to a table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from shelfwise.operators.cleaning import parse_date_column, parse_number_column, trim_columns
from shelfwise.operators.dedup import dedup_by_key, dedup_exact
from shelfwise.operators.profiling import text_columns
from shelfwise.operators.variants import harmonize
from shelfwise.roles import has_role, key_columns

STEP_SCHEMA = T.StructType(
    [
        T.StructField("step_no", T.IntegerType()),
        T.StructField("step_id", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("affected_fields", T.ArrayType(T.StringType())),
        T.StructField("risk", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("transformation_type", T.StringType()),
        T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
        T.StructField("status", T.StringType()),
    ]
)

# Fixed values: (transformation, risk) by the label used in step ids.
STEP_KINDS = {
    "trim_whitespace": ("strip_whitespace", "low"),
    "parse_numeric": ("parse_currency_numeric", "low"),
    "standardize_dates": ("standardize_dates", "medium"),
    "standardize_category": ("standardize_categories", "medium"),
    "deduplicate_by_pk": ("deduplicate_by_pk", "high"),
    "deduplicate_exact_rows": ("deduplicate_exact", "medium"),
}


@dataclass(frozen=True)
class Step:
    step_no: int
    step_id: str
    reason: str
    affected_fields: list[str]
    risk: str
    transformation_type: str
    parameters: dict[str, str] = field(default_factory=dict)
    status: str = "planned"
    source: str = "code"

    def as_row(self) -> tuple:
        return tuple(getattr(self, f.name) for f in STEP_SCHEMA.fields)


def build_steps(
    issues: Iterable[Row],
    df: DataFrame,
    dataset: str,
    day_first: Mapping[str, bool] | None = None,
    keys: Mapping[str, tuple[str, ...]] | None = None,
) -> list[Step]:
    """Ordered steps for a table; ``issues`` has a few rows per column at most.

    A step names its columns in ``affected_fields``, one entry each, so names may
    hold commas; the parameters repeat them as text for readers.
    """
    issues = list(issues)
    position = {c: i for i, c in enumerate(df.columns)}
    keys_by_field = {",".join(k): list(k) for k in key_columns(dataset, df.columns, keys)}
    steps: list[Step] = []

    def add(label, fields, reason, parameters=None, suffix=""):
        kind, risk = STEP_KINDS[label]
        number = len(steps) + 1
        steps.append(
            Step(number, f"{dataset}_step_{number:02d}_{label}{suffix}", reason, list(fields),
                 risk, kind, parameters or {})
        )

    def fields_of(*types):
        found = {i["field"] for i in issues if i["issue_type"] in types and i["field"]}
        return sorted(found, key=lambda c: position.get(c, len(position)))

    trimmed = sorted(set(fields_of("whitespace_case")) | set(text_columns(df)))
    if trimmed:
        add("trim_whitespace", trimmed, "Remove outer white space and invisible characters",
            {"columns": ",".join(trimmed)})
    for c in fields_of("currency_formats"):
        add("parse_numeric", [c], f"Turn the number text of '{c}' into numbers",
            {"column": c}, f"_{c}")
    for c in fields_of("inconsistent_dates"):
        known = (day_first or {}).get(c)
        order = "infer" if known is None else str(known).lower()
        add("standardize_dates", [c], f"Write the dates of '{c}' as year-month-day",
            {"column": c, "output_format": "yyyy-MM-dd", "day_first": order}, f"_{c}")
    for c in fields_of("suspicious_categories", "whitespace_case"):
        if has_role(c, "category_like"):
            add("standardize_category", [c], f"Give the variants of '{c}' one spelling",
                {"column": c}, f"_{c}")
    repeated = [i for i in issues if i["issue_type"] == "duplicate_records"]
    found = [keys_by_field.get(i["field"], [i["field"]]) for i in repeated if i["field"]]
    by_key = sorted(found, key=lambda names: position.get(names[0], len(position)))
    if by_key:
        shown = ",".join(by_key[0])
        add("deduplicate_by_pk", by_key[0], f"Keep the fullest row per '{shown}'", {"pk_column": shown})
    elif repeated:
        add("deduplicate_exact_rows", df.columns, "Drop rows that repeat another row")
    return steps


def steps_frame(spark: SparkSession, steps: list[Step]) -> DataFrame:
    return spark.createDataFrame([s.as_row() for s in steps], STEP_SCHEMA)


def _apply(df: DataFrame, step: Step) -> DataFrame | None:
    p = step.parameters
    kind = step.transformation_type
    if kind == "strip_whitespace":
        return trim_columns(df, step.affected_fields)
    if kind == "parse_currency_numeric":
        return parse_number_column(df, p["column"])
    if kind == "standardize_dates":
        order = {"true": True, "false": False}.get(p.get("day_first"), "infer")
        return parse_date_column(df, p["column"], order, p.get("output_format", "yyyy-MM-dd"))
    if kind == "standardize_categories":
        return harmonize(df, p["column"])
    if kind == "deduplicate_exact":
        return dedup_exact(df)
    if kind == "deduplicate_by_pk":
        return dedup_by_key(df, step.affected_fields, p.get("null_keys", "keep"))
    return None


def apply_steps(df: DataFrame, steps: list[Step]) -> tuple[DataFrame, list[Step]]:
    """Apply the steps in order; one that fails is marked and the rest go on."""
    done = []
    for step in steps:
        try:
            result = _apply(df, step)
        except Exception as error:
            reason = f"{step.reason} [Error: {str(error).splitlines()[0]}]"
            done.append(replace(step, status="failed", reason=reason))
            continue
        if result is not None:
            df = result
        done.append(replace(step, status="skipped" if result is None else "applied"))
    return df, done
