"""A whole cleaning run: profile, detect, plan, clean, check again, keep."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from shelfwise.operators.dedup import same_rows
from shelfwise.operators.issues import detect_issues, issue_signals
from shelfwise.operators.profiling import profile
from shelfwise.plans.cleaning_plan import Step, apply_steps, build_steps, steps_frame
from shelfwise.session import stage
from shelfwise.sources.tables import write_csv, write_metadata


@dataclass(frozen=True)
class CleaningRun:
    dataset: str
    raw: DataFrame
    clean: DataFrame
    issues: list[Row]
    steps: list[Step]
    unresolved: list[str]
    idempotent: bool

    def profile_before(self, approx: bool = False) -> DataFrame:
        return profile(self.raw, approx)

    def profile_after(self, approx: bool = False) -> DataFrame:
        return profile(self.clean, approx)

    def steps_frame(self) -> DataFrame:
        return steps_frame(self.raw.sparkSession, self.steps)

    def delta(self) -> DataFrame:
        return delta_report(self.raw, self.clean, self.unresolved, self.idempotent)


def plan_and_apply(
    df: DataFrame, dataset: str, keys: Mapping[str, tuple[str, ...]] | None = None
) -> tuple[DataFrame, list[Row], list[Step]]:
    """(cleaned table, issues, steps). The issues and signals are a few rows
    per column; the cleaned table stays a lazy plan."""
    signals = issue_signals(df).collect()
    issues = detect_issues(df, dataset, keys, signals=signals).collect()
    day_first = {s["column"]: s["day_first"] for s in signals}
    steps = build_steps(issues, df, dataset, day_first, keys)
    clean, done = apply_steps(df, steps)
    return clean, issues, done


def delta_report(
    raw: DataFrame, clean: DataFrame, unresolved: list[str], idempotent: bool
) -> DataFrame:
    counts = (
        raw.select(F.lit(1).alias("b"), F.lit(0).alias("a"))
        .unionByName(clean.select(F.lit(0).alias("b"), F.lit(1).alias("a")))
        .agg(
            F.coalesce(F.sum("b"), F.lit(0)).alias("rows_before"),
            F.coalesce(F.sum("a"), F.lit(0)).alias("rows_after"),
        )
    )

    def texts(values):
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return counts.select(
        "rows_before",
        "rows_after",
        (F.col("rows_after") - F.col("rows_before")).alias("row_delta"),
        texts(raw.columns).alias("schema_before"),
        texts(clean.columns).alias("schema_after"),
        F.lit(raw.columns != clean.columns).alias("schema_mutated"),
        texts(unresolved).alias("unresolved_issues"),
        F.lit(idempotent).alias("idempotent"),
    )


def run_cleaning(
    df: DataFrame,
    dataset: str,
    keys: Mapping[str, tuple[str, ...]] | None = None,
    out_dir: str | None = None,
    run_id: str = "run",
    stage_input: bool = False,
    output: str = "parquet",
) -> CleaningRun:
    """Clean a table and prove that cleaning it again changes nothing.

    The cleaned table is written once to the shared folder; the second
    detection, the second cleaning and the comparison read it from there.
    ``stage_input`` does the same with the raw table, worth it where reading
    it is dear (CSV, a long plan): the checks read it column by column.
    ``output`` names the format of what ``out_dir`` gets, parquet or csv.
    """
    if stage_input:
        df = stage(df, f"{dataset}-raw")
    lazy, issues, steps = plan_and_apply(df, dataset, keys)
    clean = stage(lazy, f"{dataset}-clean")
    again, left, _ = plan_and_apply(clean, f"{dataset}_clean", keys)
    unresolved = [i["description"] for i in left if i["severity"] == "high"]
    idempotent = same_rows(clean, again)
    run = CleaningRun(dataset, df, clean, issues, steps, unresolved, idempotent)
    if out_dir:
        paths = {version: f"{out_dir}/{dataset}_{version}.{output}" for version in ("raw", "clean")}
        for version, table in (("raw", df), ("clean", clean)):
            if output == "csv":
                write_csv(table, paths[version])
            else:
                table.write.mode("overwrite").parquet(paths[version])
        meta = run.delta().select(
            F.lit(run_id).alias("run_id"),
            F.lit(dataset).alias("dataset_name"),
            F.lit(paths["raw"]).alias("raw_artifact"),
            F.lit(paths["clean"]).alias("clean_artifact"),
            "rows_before",
            "rows_after",
            "idempotent",
        )
        write_metadata(meta, f"{out_dir}/{dataset}_metadata.json")
    return run
