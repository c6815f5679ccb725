import pytest
from pyspark.sql import functions as F

from shelfwise.operators import dedup, frequency, issues, profiling, quantiles
from shelfwise.plans.cleaning_plan import Step, apply_steps
from shelfwise.plans.cleaning_run import run_cleaning
from shelfwise.plans.quality_report import quality_report
from shelfwise.sources import tables

ORDERS = [
    ("O1", " $10.00 ", "2024-01-01", "Electronics"),
    ("O2", "$20.50", "02/01/2024", "Elecronics"),
    ("O1", " $10.00 ", "2024-01-01", "Electronics"),
]
ORDER_COLUMNS = "order_id string, price string, order_date string, category string"


def kinds(df):
    return {r["column"]: r["inferred_type"] for r in profiling.infer_types(df).collect()}


def test_types(spark):
    df = spark.createDataFrame(
        [("ORD-1", "$19.99", "West", "yes", "2024-01-01", None), ("ORD-2", "$25.50", "West", "no", "02/01/2024", None)],
        "order_id string, price string, region string, paid_flag string, ship_date string, note string",
    )
    assert kinds(df) == {
        "order_id": "identifier", "price": "currency", "region": "categorical",
        "paid_flag": "boolean", "ship_date": "datetime", "note": "empty",
    }


def test_profile(spark):
    df = spark.createDataFrame(
        [("O1", 10.0, "A"), ("O2", 20.0, "B"), ("O3", 30.0, "A")], "order_id string, amount double, category string"
    )
    table = profiling.table_profile(df, "t").first()
    assert (table.row_count, table.column_count, table.duplicate_row_count) == (3, 3, 0)
    rows = {r["column"]: r for r in profiling.profile(df).collect()}
    amount = rows["amount"]
    assert (amount["mean"], amount["median"], amount["std"], amount["q25"]) == (20.0, 20.0, 10.0, 15.0)
    assert rows["category"]["top_frequencies"] == {"A": 2, "B": 1}
    assert rows["order_id"]["is_unique"] and rows["order_id"]["sample_values"] == ["O1", "O2", "O3"]
    approx = {r["column"]: r for r in profiling.profile(df, approx=True).collect()}
    assert approx["category"]["top_frequencies"] == {"A": 2, "B": 1}


def test_profile_of_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "amount double, note string")
    rows = {r["column"]: r for r in profiling.profile(empty).collect()}
    assert rows["amount"]["inferred_type"] == "empty" and rows["amount"]["null_percentage"] == 0.0
    assert profiling.table_profile(empty, "e").first().row_count == 0
    one = spark.createDataFrame([(5.0,)], "amount double")
    assert profiling.profile(one).first()["std"] == 0.0


@pytest.mark.parametrize("accuracy", [50, 100_000])
def test_percentiles_are_exact(spark, accuracy):
    import numpy as np

    rng = np.random.default_rng(7)
    xs = np.concatenate([rng.normal(size=1500), np.full(1200, 0.25), rng.exponential(size=801)])
    df = spark.createDataFrame([("a", float(x)) for x in xs] + [("b", 3.0)], "column string, x double")
    found = quantiles.exact_percentiles(df.repartition(5), [0, 0.25, 0.5, 0.75, 0.99, 1], accuracy)
    for r in found.collect():
        expected = np.quantile(xs, r["probability"]) if r["column"] == "a" else 3.0
        assert abs(r["value"] - expected) < 1e-12


def test_duplicates_count_null_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert frequency.duplicate_row_count(df).first().duplicate_row_count == 1


def test_issues(spark):
    df = spark.createDataFrame(ORDERS, ORDER_COLUMNS)
    found = {r.issue_type for r in issues.detect_issues(df, "orders").collect()}
    assert found == {
        "duplicate_records", "whitespace_case", "currency_formats", "inconsistent_dates", "suspicious_categories",
    }


def test_comma_in_text_is_no_currency_and_trailing_space_is_found(spark):
    df = spark.createDataFrame([("Smith, Bob", "a "), ("Jones, Al", "b")], "name string, tag string")
    found = {r.id: r.affected_count for r in issues.detect_issues(df, "people").collect()}
    assert found == {"people_tag_whitespace": 1}


def test_order_items_are_not_keyed_by_order(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "order_id int, product_id int")
    assert issues.detect_issues(df, "order_items").isEmpty()
    assert [r.id for r in issues.detect_issues(df, "orders").collect()] == ["orders_order_id_duplicate_keys"]


def test_dedup_by_key(spark):
    rows = [(1, "a", None), (1, "a", "x"), (None, "b", None), (None, "b", None), (2, None, None)]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    kept = dedup.dedup_by_key(df, ["k"])
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(
        [(1, "a", "x"), (2, None, None), (None, "b", None), (None, "b", None)], key=repr
    )
    assert dedup.dedup_by_key(df, ["k"], null_keys="collapse").count() == 3
    plan = dedup.dedup_by_key(df, ["k"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("output", ["parquet", "csv"])
def test_cleaning_run(spark, tmp_path, output):
    df = spark.createDataFrame(
        [("O1", "$10.00", "2024-01-01", "Electronics"), ("O2", "$20.50", "02/01/2024", "Elecronics"),
         ("O1", "$10.00", "2024-01-01", "Electronics")],
        ORDER_COLUMNS,
    )
    run = run_cleaning(df, "orders_test", out_dir=str(tmp_path), output=output)
    delta = run.delta().first()
    assert (delta.row_delta, delta.schema_mutated, delta.idempotent) == (-1, False, True)
    assert [s.transformation_type for s in run.steps] == [
        "strip_whitespace", "parse_currency_numeric", "standardize_dates", "standardize_categories",
        "deduplicate_by_pk",
    ]
    assert {s.status for s in run.steps} == {"applied"}
    assert sorted(tuple(r) for r in run.clean.collect()) == [
        ("O1", 10.0, "2024-01-01", "Electronics"), ("O2", 20.5, "2024-02-01", "Electronics"),
    ]
    assert tables.read_table(spark, f"{tmp_path}/orders_test_clean.{output}").count() == 2
    assert spark.read.json(f"{tmp_path}/orders_test_metadata.json").first().idempotent


def test_failing_and_unknown_steps(spark):
    df = spark.createDataFrame([("a",)], "x string")
    steps = [
        Step(1, "s1", "r", ["x"], "low", "standardize_dates", {"column": "x", "day_first": "false", "output_format": "yyyy"}),
        Step(2, "s2", "r", ["y"], "low", "deduplicate_by_pk", {"pk_column": "missing"}),
        Step(3, "s3", "r", ["x"], "low", "no_such_kind", {}),
        Step(4, "s4", "r", ["z"], "low", "strip_whitespace", {"columns": "z"}),
    ]
    result, done = apply_steps(df, steps)
    assert [s.status for s in done] == ["applied", "failed", "skipped", "failed"]
    assert "[Error:" in done[1].reason and result.count() == 1


def test_names_with_commas(spark):
    """Columns are lists throughout: trimmed, and deduplicated by a key of two such columns."""
    df = spark.createDataFrame([("k, 1", " a ", "1"), ("k, 1", "a", None), ("k2", " b", "2")], ["id, no", "name, full", "v"])
    run = run_cleaning(df, "orders", keys={"orders": ("id, no", "name, full")})
    assert {s.transformation_type: s.affected_fields for s in run.steps} == {
        "strip_whitespace": ["id, no", "name, full", "v"],
    }
    assert sorted(tuple(r)[1] for r in run.clean.collect()) == ["a", "a", "b"]
    again = run_cleaning(run.clean, "orders", keys={"orders": ("id, no", "name, full")})
    assert [s.affected_fields for s in again.steps if s.transformation_type == "deduplicate_by_pk"] == [["id, no", "name, full"]]
    assert sorted(tuple(r) for r in again.clean.collect()) == [("k, 1", "a", "1"), ("k2", "b", "2")]


def test_report_isolates_errors(spark):
    good = spark.createDataFrame([("O1", "$1.00", "2024-01-01", "A")], ORDER_COLUMNS)
    bad = good.withColumn("price", F.raise_error(F.lit("broken")).cast("string"))
    report = quality_report({"orders": good, "broken": bad}).collect()
    assert {r.status for r in report if r.dataset == "broken"} == {"error"}
    assert {(r.check, r.value) for r in report if r.dataset == "orders"} >= {("row_count", 1), ("idempotent", 1)}


def test_report_reads_its_input_once(spark):
    """The source is worked out once, and its rows are dealt to all tasks."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(value):
        seen.add(1)
        return value

    rows = [(f"O{n}", f"${n}.00", "2024-01-01", "A") for n in range(40)]
    df = spark.createDataFrame(rows, ORDER_COLUMNS).coalesce(1)
    report = quality_report({"orders": df.withColumn("price", passed("price"))}).collect()
    assert seen.value == 40
    assert {(r.check, r.value) for r in report} >= {("row_count", 40), ("rows_after", 40), ("idempotent", 1)}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', float("nan")), (2, None, 1.005)], "i int, t string, x double")
    tables.write_csv(df, f"{tmp_path}/in/first.csv")
    loaded = tables.read_folder(spark, f"{tmp_path}/in")
    assert list(loaded) == ["first"]
    assert sorted((r.i, r.t) for r in loaded["first"].collect()) == [("1", 'a "q", b'), ("2", None)]
    both = tables.read_tables(spark, {"a": f"{tmp_path}/in/first.csv", "b": f"{tmp_path}/none.csv"})
    assert list(both) == ["a"]
    shown = tables.preview(df, ["i"], 1).first()
    assert shown.x is None and shown.i == 1
    tables.register_versions("t", df, df)
    assert spark.table("t_raw").count() == spark.table("t_clean").count() == 2


def test_signals_of_shapes_equal_those_of_values(spark):
    """Every rule, asked of shapes and of the values themselves."""
    import random

    from shelfwise.functions.dates import DASH_LAYOUT, SLASH_LAYOUT, first_part_over_12, to_iso_date
    from shelfwise.functions.numbers import CURRENCY_ANY, looks_like_currency, to_number
    from shelfwise.functions.text import strip

    r = random.Random(6)
    values = [
        None, "", " ", "0", "1", " 1 ", "10", "yes", " No ", "TRUE", "falsey", "t", "1e5", "1E+300", "12e", "e", "(12.50)", "( 3)", "-(3)",
        "$1,234.50", "1,2", "12-", "+.5", "5.", "1.2.3", "2024-01-02", "2024-1-2 10:00", "13/01/2024", "1/2/24", "31/31/2024", "20240102",
        "1700000000", "Jan 5, 2024", "5 Feb 2024", "abc def 12", "٥", "12%", "€ 5", "1-2", "12:30", "x" * 40, "9" * 40, "9e9999",
    ]
    values += ["".join(r.choice("01239 eEaZ$,.()-/%") for _ in range(r.randint(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(v, v, None if v is None else 1) for v in values], "code string, order_date string, n int")
    got = {s["column"]: s.asDict() for s in issues.issue_signals(df).collect()}
    assert set(got) == {"code", "order_date", "n"} and got["n"]["value_count"] == len(values) - 1 and not got["n"]["is_text"]
    for column in ("code", "order_date"):
        c = F.col(column)
        digit, dated = c.rlike(r"\d"), F.lit(column == "order_date")
        words = [w for w in profiling.BOOLEAN_WORDS]
        want = df.agg(
            F.count("*").alias("row_count"), F.count(c).alias("value_count"), F.count_if(c != strip(c)).alias("padded_count"),
            F.bool_or(c.rlike(CURRENCY_ANY) & looks_like_currency(c)).alias("has_currency"),
            F.count_if(c.rlike(CURRENCY_ANY)).alias("currency_count"), F.count_if(F.lower(strip(c)).isin(*words)).alias("boolean_count"),
            F.count_if(digit & to_number(c).isNotNull()).alias("number_count"),
            F.count_if(dated & digit & c.rlike(DASH_LAYOUT)).alias("dash_count"),
            F.count_if(dated & digit & c.rlike(SLASH_LAYOUT)).alias("slash_count"),
            F.bool_or(dated & digit & first_part_over_12(strip(c))).alias("day_first"),
            F.count_if(dated & digit & to_iso_date(strip(c)).isNotNull()).alias("date_count"),
        ).first().asDict()
        assert {k: got[column][k] for k in want} == want
