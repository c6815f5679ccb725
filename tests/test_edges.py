"""Empty column sets, wide money, line breaks, exact samples, phrase lookup, bounded categories."""

import random
from decimal import Decimal

from shelfwise.functions.numbers import to_money
from shelfwise.operators import filters, issues, profiling
from shelfwise.operators.frequency import value_counts
from shelfwise.plans import quality_report as reports
from shelfwise.sources import tables
from pyspark.sql import functions as F


def test_no_columns_give_no_rows(spark):
    df = spark.range(3)
    for found in (
        profiling.numeric_stats(df, []), issues.mixed_type_columns(df), profiling.parse_failures(df),
        profiling.null_counts(df, []), profiling.distinct_counts(df, []), issues.issue_signals(df, []),
        value_counts(df, []), profiling.datetime_ranges(df, []),
    ):
        assert found.count() == 0 and "column" in found.columns


def test_money_of_any_size(spark):
    texts = ["$123,456,789,012,345.25", "0.123456", "(1e14)"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(to_money(F.col("t"))).collect()]
    assert got[:2] == [Decimal("123456789012345.250000"), Decimal("0.123456")]


def test_csv_keeps_line_breaks(spark, tmp_path):
    rows = [("a", 'one\ntwo "quoted", three'), ("b", "plain")]
    df = spark.createDataFrame(rows, "id string, note string")
    tables.write_csv(df, str(tmp_path / "notes.csv"))
    got = tables.read_csv(spark, str(tmp_path / "notes.csv")).orderBy("id").collect()
    assert [tuple(r) for r in got] == rows


def test_samples_are_the_least_distinct_flagged_values(spark):
    rng = random.Random(4)
    for trial in range(5):
        flagged = {f" v{rng.randrange(10**6)}" for _ in range(3)}
        values = [*flagged, *flagged, "clean"]
        df = spark.createDataFrame([(v,) for v in values], "c string").repartition(3)
        got = issues.flagged_samples(df, [("c", "whitespace")]).first()
        assert got.sample_values == sorted(flagged), trial
    some = issues.flagged_samples(spark.createDataFrame([(f" {i}",) for i in range(9)], "c string"), [("c", "whitespace")])
    assert some.first().sample_values == [" 0", " 1", " 2"]
    everything = issues.flagged_samples(spark.createDataFrame([(f" {i}",) for i in range(9)], "c string"), [("c", "whitespace")], None)
    assert len(everything.first().sample_values) == 9


def test_categories_without_a_bound(spark):
    values = [f"word{i:03d}x" for i in range(60)] + ["Shoes", "SHOES"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "label string, n int")
    bounded = {r.id for r in issues.detect_issues(df, "t").collect()}
    assert "t_label_inconsistent_case" not in bounded
    found = {r.id: r for r in issues.detect_issues(df, "t", max_categories=None).collect()}
    assert found["t_label_inconsistent_case"].sample_values == ["SHOES", "Shoes"]


def test_find_value(spark):
    df = spark.createDataFrame(
        [("Dana Evans", "x dana", 1), ("dana evans", None, 2), ("Other", "none", 3), ("Dana Evans", None, 4)],
        "name string, note string, n int",
    )
    got = [tuple(r) for r in filters.find_value(df, "Dana").collect()]
    assert got == [("name", "Dana Evans", 2), ("name", "dana evans", 1), ("note", "x dana", 1)]
    assert filters.find_value(df, "").isEmpty() and filters.find_value(df.select("n"), "1").isEmpty()


def test_scalar_results_go_on_after_an_error(spark):
    df = spark.range(4)
    specs = {
        "a": {"dataset": "t", "metrics": [{"agg": "count", "field": "*"}]},
        "b": {"dataset": "nope"},
    }
    got = {r.case: (r.status, r.scalar_value) for r in reports.scalar_results({"t": df}, specs).collect()}
    assert got["a"] == ("ok", "4") and got["b"][0].startswith("error: dataset 'nope'")
