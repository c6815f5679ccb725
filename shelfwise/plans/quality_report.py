"""Quality checks over many tables, expectations, raw beside clean."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators.dedup import same_rows
from shelfwise.operators.profiling import table_profile
from shelfwise.plans.cleaning_run import plan_and_apply
from shelfwise.plans.declared_query import evidence, run_query
from shelfwise.session import stage

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("check", T.StringType()),
        T.StructField("value", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)


def _spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to all tasks, so that a file of one row group keeps no core idle."""
    return df.repartition(F.monotonically_increasing_id())


def _table_rows(df: DataFrame, dataset: str, keys) -> DataFrame:
    # A dozen passes follow; they read what was written once, column by column, in parts of one size.
    df = stage(_spread(df), f"{dataset}-raw")
    lazy, issues, _ = plan_and_apply(df, dataset, keys)
    clean = stage(lazy, f"{dataset}-clean")
    again, left, _ = plan_and_apply(clean, f"{dataset}_clean", keys)
    unresolved = sum(1 for i in left if i["severity"] == "high")
    idempotent = same_rows(clean, again)
    spark = df.sparkSession
    found = [
        (dataset, i["id"][len(dataset) + 1 :], i["affected_count"],
         "failed" if i["severity"] == "high" else "warning")
        for i in issues
    ]
    found.append((dataset, "unresolved_high", unresolved, "failed" if unresolved else "ok"))
    found.append((dataset, "idempotent", int(idempotent), "ok" if idempotent else "failed"))
    profiled = table_profile(df, dataset).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(dataset).alias("dataset"), F.lit(c).alias("check"),
                             F.col(c).alias("value"), F.lit("ok").alias("status"))
                    for c in ("row_count", "column_count", "duplicate_row_count")
                ]
            )
        )
    )
    after = clean.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit(dataset).alias("dataset"), F.lit("rows_after").alias("check"), "value",
        F.lit("ok").alias("status"),
    )
    parts = [profiled, after, spark.createDataFrame(found, REPORT_SCHEMA)]
    return reduce(DataFrame.unionByName, parts)


def quality_report(
    tables: Mapping[str, DataFrame], keys: Mapping[str, tuple[str, ...]] | None = None
) -> DataFrame:
    """(dataset, check, value, status) over all tables. A table that fails
    becomes one row of status ``error`` and the others go on."""
    parts = []
    for name, df in tables.items():
        try:
            parts.append(_table_rows(df, name, keys))
        except Exception as error:
            row = (name, f"error: {type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}", None, "error")
            parts.append(df.sparkSession.createDataFrame([row], REPORT_SCHEMA))
    return reduce(DataFrame.unionByName, parts)


def match_expectations(results: DataFrame, expected: DataFrame, on: list[str]) -> DataFrame:
    """Results with expectations beside them and whether they agree.

    Both have a status and may have a scalar_value; what an expectation leaves
    null is not checked, and a case without a result does not match.
    """
    named = expected.select(
        *on,
        F.col("status").alias("expected_status"),
        *([F.col("scalar_value").alias("expected_value")] if "scalar_value" in expected.columns else []),
    )
    joined = named.join(results, on, "left")
    agrees = F.col("expected_status").isNull() | F.col("status").eqNullSafe(F.col("expected_status"))
    if "expected_value" in joined.columns:
        agrees = agrees & (
            F.col("expected_value").isNull()
            | F.col("scalar_value").eqNullSafe(F.col("expected_value"))
        )
    return joined.withColumn("expected_match", agrees)


def raw_beside_clean(
    raw: Mapping[str, DataFrame], clean: Mapping[str, DataFrame], spec: Mapping
) -> DataFrame:
    """The same query over the raw and the clean tables, with the version."""
    parts = [
        run_query(tables, spec).withColumn("version", F.lit(version))
        for version, tables in (("raw", raw), ("clean", clean))
    ]
    return parts[0].unionByName(parts[1])


def scalar_results(tables: Mapping[str, DataFrame], specs: Mapping[str, Mapping]) -> DataFrame:
    """(case, status, scalar_value) of a batch of descriptions, one row each.

    The scalar is the value of a single global metric as text, else null. A
    case that fails becomes a row of status ``error`` and the others go on.
    """
    parts = []
    for case, spec in specs.items():
        try:
            found = evidence(tables, spec).select(
                F.lit(case).alias("case"),
                F.when(F.col("rows_returned") > 0, "ok").otherwise("empty").alias("status"),
                F.col("scalar_answer").alias("scalar_value"),
            )
        except Exception as error:
            session = next(iter(tables.values())).sparkSession
            found = session.createDataFrame(
                [(case, f"error: {str(error).splitlines()[0]}", None)], "case string, status string, scalar_value string"
            )
        parts.append(found)
    return reduce(DataFrame.unionByName, parts)
