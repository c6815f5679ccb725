"""The queries of a session, each with the filters it inherits, and batches of queries with answer and trace."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.plans.declared_query import answer_text, evidence

RESULT = (
    "case string, status string, answer_type string, summary string, scalar_value string, filters array<string>, "
    "rows_considered bigint, rows_returned bigint, operations array<string>, preview array<string>"
)


def carried_specs(turns: Sequence[Mapping], distinct_fields: bool = False) -> list[dict]:
    """The descriptions of a session's turns with the filters that hold there.

    A turn has ``spec`` and maybe ``follow_up``. A follow-up adds its filters to
    what the session holds; another turn runs with its own, which replace what is
    held unless it has none. ``distinct_fields`` keeps, of filters on one field,
    those of the last turn that names it. The same rules as in
    ``sessions.session_filters``, for descriptions that are to be run.
    """
    held: list[Mapping] = []
    specs = []
    for turn in turns:
        own = list(turn["spec"].get("filters", []))
        filters = own
        if turn.get("follow_up"):
            named = {f["field"] for f in own} if distinct_fields else set()
            filters = [f for f in held if f["field"] not in named] + own
        held = filters or held
        specs.append({**turn["spec"], "filters": filters})
    return specs


def _answered(tables: Mapping[str, DataFrame], case: str, spec: Mapping) -> DataFrame:
    trace, answer = evidence(tables, spec), answer_text(tables, spec)
    # One row each; they meet in one aggregate.
    both = trace.unionByName(answer, allowMissingColumns=True).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in (*answer.columns, *trace.columns)]
    )
    return both.select(
        F.lit(case).alias("case"),
        F.when(F.col("rows_considered") > 0, "ok").otherwise("empty").alias("status"),
        "answer_type", "summary", F.col("scalar_answer").alias("scalar_value"), "filters",
        "rows_considered", "rows_returned", "operations", "preview",
    )


def batch_results(tables: Mapping[str, DataFrame], specs: Mapping[str, Mapping]) -> DataFrame:
    """One row per case: answer, scalar and trace of a batch of descriptions.

    ``status`` is ok, or empty where no row passed the filters. A case that
    fails becomes a row of status ``error`` with the reason as its summary.
    """
    session = next(iter(tables.values())).sparkSession
    parts = []
    for case, spec in specs.items():
        try:
            parts.append(_answered(tables, case, spec))
        except Exception as error:
            row = (case, "error", None, str(error).splitlines()[0], *[None] * 6)
            parts.append(session.createDataFrame([row], RESULT))
    return reduce(DataFrame.unionByName, parts, session.createDataFrame([], RESULT))


def session_results(
    tables: Mapping[str, DataFrame], turns: Sequence[Mapping], distinct_fields: bool = False
) -> DataFrame:
    """``batch_results`` of a session's turns, numbered from 1, each run with what it inherits."""
    specs = carried_specs(turns, distinct_fields)
    found = batch_results(tables, {str(i): s for i, s in enumerate(specs, 1)})
    return found.withColumnRenamed("case", "turn").withColumn("turn", F.col("turn").cast("int"))
