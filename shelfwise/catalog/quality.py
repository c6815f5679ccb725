"""Issues, cleaning and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.catalog import inputs, sql
from shelfwise.catalog.inputs import table
from shelfwise.catalog.registry import query
from shelfwise.functions.dates import parse_dates
from shelfwise.functions.numbers import to_money
from shelfwise.functions.text import title_case
from shelfwise.operators import cleaning, dedup, issues, variants
from shelfwise.plans import quality_report as reports
from shelfwise.plans.cleaning_plan import build_steps, steps_frame
from shelfwise.plans.cleaning_run import plan_and_apply, run_cleaning
from shelfwise.session import scratch_path, stage

ITEM_KEYS = {"lines": ("order_id", "line_no")}

ORDERS_CTE = f"d AS ({inputs.DIRTY_ORDERS})"
PART_CTE = f"p AS ({inputs.DIRTY_PART})"
REPEATED_ROWS = "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d) u) FROM d"
REPEATED_KEYS = "SELECT count(*) - count(DISTINCT order_id) FROM d"
PADDED = "regexp_matches({c}, '^\\s+|\\s+$')"
CURRENCY = "'[\\$,€£¥]|\\(\\d+(\\.\\d+)?\\)|\\d{1,3}(,\\d{3})+'"
SLASHED = "'^\\d{1,2}/\\d{1,2}/\\d{2,4}'"
DASHED = "'^\\d{4}-\\d{1,2}-\\d{1,2}'"


def _pick(df):
    return df.select("field", "issue_type", "severity", "affected_count")


@query(
    "issue_duplicate_rows",
    f"""WITH {ORDERS_CTE} SELECT 'orders_issue_duplicate_rows' AS id,
        ({REPEATED_ROWS}) AS affected_count""",
)
def issue_duplicate_rows(spark, folder):
    found = issues.duplicate_row_issue(inputs.dirty_orders(spark, folder), "orders")
    return found.select("id", "affected_count")


@query(
    "issue_all_null",
    f"""WITH {PART_CTE}, c AS (SELECT count(*) AS n, count(note) AS filled FROM p)
        SELECT 'note' AS field, 'missing_values' AS issue_type, 'high' AS severity,
               n AS affected_count FROM c WHERE filled = 0""",
)
def issue_all_null(spark, folder):
    found = issues.detect_issues(inputs.dirty_part(spark, folder), "products")
    return _pick(found.where("issue_type = 'missing_values'"))


@query(
    "issue_whitespace",
    f"""WITH {ORDERS_CTE}, w AS (
          SELECT 'status' AS "column", count(*) FILTER ({PADDED.format(c='status')}) AS n FROM d
          UNION ALL SELECT 'order_date', count(*) FILTER ({PADDED.format(c='order_date')}) FROM d
          UNION ALL SELECT 'amount_text', count(*) FILTER ({PADDED.format(c='amount_text')}) FROM d)
        SELECT "column", n AS padded_count FROM w WHERE n > 0""",
)
def issue_whitespace(spark, folder):
    signals = issues.issue_signals(inputs.dirty_orders(spark, folder))
    return signals.where("padded_count > 0").select("column", "padded_count")


@query(
    "issue_currency",
    f"""WITH {ORDERS_CTE} SELECT 'amount_text' AS "column",
          count(*) FILTER (regexp_matches(amount_text, {CURRENCY})) AS currency_count,
          count({sql.number('amount_text')}) AS number_count FROM d""",
)
def issue_currency(spark, folder):
    signals = issues.issue_signals(inputs.dirty_orders(spark, folder))
    enough = F.col("number_count") >= issues.MIN_PARSE_RATIO * F.col("value_count")
    return signals.where(F.col("has_currency") & enough).select(
        "column", "currency_count", "number_count"
    )


@query(
    "issue_dates",
    f"""WITH {ORDERS_CTE} SELECT 'order_date' AS "column",
          count(*) FILTER (regexp_matches(order_date, {DASHED})) AS dash_count,
          count(*) FILTER (regexp_matches(order_date, {SLASHED})) AS slash_count FROM d""",
)
def issue_dates(spark, folder):
    signals = issues.issue_signals(inputs.dirty_orders(spark, folder))
    return signals.where("dash_count > 0 AND slash_count > 0").select(
        "column", "dash_count", "slash_count"
    )


@query(
    "issue_case_variants",
    f"""WITH {PART_CTE}, v AS (SELECT 'category' AS "column", trim(category) AS value FROM p
          UNION ALL SELECT 'brand', trim(brand) FROM p)
        SELECT "column", lower(value) AS key, count(DISTINCT value) AS variant_count,
               array_to_string(list_sort(list(DISTINCT value)), '|') AS variants, count(*) AS n
        FROM v WHERE value IS NOT NULL GROUP BY "column", lower(value)
        HAVING count(DISTINCT value) > 1""",
)
def issue_case_variants(spark, folder):
    counts = issues.category_counts(inputs.dirty_part(spark, folder), ["category", "brand", "name"])
    found = variants.case_variants(counts)
    return found.withColumn("variants", F.array_join("variants", "|"))


@query(
    "issue_case_variants_all",
    f"""WITH {PART_CTE}, v AS (SELECT 'category' AS "column", trim(category) AS value FROM p
          UNION ALL SELECT 'brand', trim(brand) FROM p UNION ALL SELECT 'name', trim(name) FROM p)
        SELECT "column", lower(value) AS key, count(DISTINCT value) AS variant_count,
               array_to_string(list_sort(list(DISTINCT value)), '|') AS variants, count(*) AS n
        FROM v WHERE value IS NOT NULL GROUP BY "column", lower(value)
        HAVING count(DISTINCT value) > 1""",
)
def issue_case_variants_all(spark, folder):
    counts = issues.category_counts(inputs.dirty_part(spark, folder), ["category", "brand", "name"], None)
    found = variants.case_variants(counts)
    return found.withColumn("variants", F.array_join("variants", "|"))


@query("issue_near_dups")
def issue_near_dups(spark, folder):
    counts = issues.category_counts(inputs.dirty_part(spark, folder), ["category", "brand", "name"])
    return issues.suspicious_pairs(counts)


@query(
    "issue_near_dups_lev",
    f"""WITH {PART_CTE}, k AS (SELECT DISTINCT 'category' AS "column", lower(trim(category)) AS key
            FROM p WHERE category IS NOT NULL
          UNION SELECT DISTINCT 'brand', lower(trim(brand)) FROM p WHERE brand IS NOT NULL),
        s AS (SELECT a."column", a.key AS a, b.key AS b,
            CAST(1.0 AS DOUBLE) - CAST(levenshtein(a.key, b.key) AS DOUBLE)
              / greatest(length(a.key), length(b.key)) AS ratio
          FROM k a JOIN k b ON a."column" = b."column" AND a.key < b.key
            AND abs(length(a.key) - length(b.key)) <= 2)
        SELECT * FROM s WHERE ratio >= CAST(0.82 AS DOUBLE) AND ratio < 1""",
)
def issue_near_dups_lev(spark, folder):
    counts = issues.category_counts(inputs.dirty_part(spark, folder), ["category", "brand", "name"])
    return issues.suspicious_pairs(counts, "levenshtein")


@query(
    "issue_near_dups_lev_all",
    f"""WITH {PART_CTE}, v AS (SELECT 'category' AS "column", trim(category) AS value FROM p
          UNION ALL SELECT 'brand', trim(brand) FROM p UNION ALL SELECT 'name', trim(name) FROM p),
        k AS (SELECT DISTINCT "column", lower(value) AS key FROM v WHERE value IS NOT NULL),
        s AS (SELECT a."column", a.key AS a, b.key AS b,
            CAST(1.0 AS DOUBLE) - CAST(levenshtein(a.key, b.key) AS DOUBLE)
              / greatest(length(a.key), length(b.key)) AS ratio
          FROM k a JOIN k b ON a."column" = b."column" AND a.key < b.key
            AND abs(length(a.key) - length(b.key)) <= 2)
        SELECT * FROM s WHERE ratio >= CAST(0.82 AS DOUBLE) AND ratio < 1""",
)
def issue_near_dups_lev_all(spark, folder):
    counts = issues.category_counts(inputs.dirty_part(spark, folder), ["category", "brand", "name"], None)
    return issues.suspicious_pairs(counts, "levenshtein")


@query("issue_near_dups_all")
def issue_near_dups_all(spark, folder):
    counts = issues.category_counts(inputs.dirty_part(spark, folder), ["category", "brand", "name"], None)
    return issues.suspicious_pairs(counts)


@query(
    "issue_duplicate_keys",
    """SELECT 'lines_l_orderkey,l_linenumber_duplicate_keys' AS id,
         count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS affected_count FROM lineitem""",
)
def issue_duplicate_keys(spark, folder):
    found = issues.duplicate_key_issue(
        table(spark, folder, "lineitem"), "lines", ("l_orderkey", "l_linenumber")
    )
    return found.select("id", "affected_count")


DETECTED = f"""
    SELECT 'orders_status_whitespace' AS id, 'status' AS field, 'whitespace_case' AS issue_type,
      'low' AS severity, count(*) FILTER ({PADDED.format(c='status')}) AS affected_count FROM d
    UNION ALL SELECT 'orders_amount_text_currency_formats', 'amount_text', 'currency_formats',
      'medium', count(*) FILTER (regexp_matches(amount_text, {CURRENCY})) FROM d
    UNION ALL SELECT 'orders_order_date_inconsistent_dates', 'order_date', 'inconsistent_dates',
      'high', count(*) FILTER (regexp_matches(order_date, {SLASHED})) FROM d
    UNION ALL SELECT 'orders_issue_duplicate_rows', NULL, 'duplicate_records', 'medium',
      ({REPEATED_ROWS})
    UNION ALL SELECT 'orders_order_id_duplicate_keys', 'order_id', 'duplicate_records', 'high',
      ({REPEATED_KEYS})
    UNION ALL SELECT 'orders_status_inconsistent_case', 'status', 'whitespace_case', 'low',
      (SELECT count(*) FROM (SELECT lower(trim(status)) FROM d GROUP BY 1
         HAVING count(DISTINCT trim(status)) > 1) x)"""


@query(
    "detect_issues",
    f"""WITH {ORDERS_CTE}, i AS ({DETECTED})
        SELECT id, issue_type, severity, affected_count FROM i WHERE affected_count > 0""",
)
def detect_issues(spark, folder):
    found = issues.detect_issues(inputs.dirty_orders(spark, folder), "orders")
    return found.select("id", "issue_type", "severity", "affected_count")


@query(
    "issue_mixed_types",
    f"""WITH {ORDERS_CTE} SELECT 'amount_text' AS "column",
          count({sql.number('amount_text')}) AS number_count,
          count(amount_text) - count({sql.number('amount_text')}) AS other_count FROM d""",
)
def issue_mixed_types(spark, folder):
    return issues.mixed_type_columns(inputs.dirty_orders(spark, folder))


@query(
    "clean_trim",
    f"""WITH {ORDERS_CTE} SELECT order_id, customer_id, trim(amount_text) AS amount_text,
          trim(order_date) AS order_date, trim(status) AS status FROM d""",
)
def clean_trim(spark, folder):
    return cleaning.trim_columns(inputs.dirty_orders(spark, folder))


@query(
    "clean_currency",
    f"""WITH {ORDERS_CTE} SELECT order_id, {sql.number('amount_text')} AS amount FROM d""",
)
def clean_currency(spark, folder):
    df = inputs.dirty_orders(spark, folder)
    return df.select("order_id", to_money(F.col("amount_text")).alias("amount"))


@query(
    "clean_dates",
    f"WITH {ORDERS_CTE} SELECT order_id, {sql.iso_date('order_date')} AS order_date FROM d",
)
def clean_dates(spark, folder):
    df = inputs.dirty_orders(spark, folder)
    return df.select("order_id", parse_dates(F.col("order_date")).alias("order_date"))


@query(
    "clean_dates_infer",
    f"WITH {ORDERS_CTE} SELECT order_id, {sql.iso_date('order_date', True)} AS order_date FROM d",
)
def clean_dates_infer(spark, folder):
    df = inputs.dirty_orders(spark, folder).select("order_id", "order_date")
    return cleaning.parse_date_column(df, "order_date", "infer")


@query(
    "clean_title_case",
    f"""WITH {PART_CTE} SELECT product_id, {sql.title('category')} AS category,
          {sql.title('name')} AS name FROM p""",
)
def clean_title_case(spark, folder):
    df = inputs.dirty_part(spark, folder)
    return df.select(
        "product_id",
        title_case(F.col("category")).alias("category"),
        title_case(F.col("name")).alias("name"),
    )


@query("clean_categories")
def clean_categories(spark, folder):
    df = inputs.dirty_part(spark, folder).select("product_id", "category")
    return variants.harmonize(df, "category")


@query(
    "clean_categories_lev",
    f"""WITH {PART_CTE}, t AS (SELECT product_id, {sql.title('category')} AS category FROM p),
        n AS (SELECT category AS value, count(*) AS n FROM t WHERE category IS NOT NULL GROUP BY 1),
        e AS (SELECT a.value AS first, a.n, b.value AS second FROM n a JOIN n b
              ON (a.n > b.n OR (a.n = b.n AND a.value < b.value))
              AND abs(length(a.value) - length(b.value)) <= 2
              AND CAST(1.0 AS DOUBLE) - CAST(levenshtein(lower(a.value), lower(b.value)) AS DOUBLE)
                  / greatest(length(a.value), length(b.value)) >= CAST(0.85 AS DOUBLE)),
        m AS (SELECT second, arg_min(first, (-n, first)) AS canonical FROM e
              WHERE first NOT IN (SELECT second FROM e) GROUP BY second)
        SELECT product_id, coalesce(canonical, category) AS category
        FROM t LEFT JOIN m ON category = second""",
)
def clean_categories_lev(spark, folder):
    df = inputs.dirty_part(spark, folder).select("product_id", "category")
    return variants.harmonize(df, "category", measure="levenshtein")


@query("dedup_exact", f"WITH {ORDERS_CTE} SELECT DISTINCT * FROM d")
def dedup_exact(spark, folder):
    return dedup.dedup_exact(inputs.dirty_orders(spark, folder))


@query(
    "dedup_by_key",
    f"""WITH i AS ({inputs.DIRTY_ITEMS}), r AS (SELECT *, row_number() OVER (
            PARTITION BY order_id, line_no ORDER BY
            (product_id IS NULL)::INT + (quantity IS NULL)::INT + (discount IS NULL)::INT
              + (tax IS NULL)::INT + (returnflag IS NULL)::INT,
            product_id NULLS FIRST, quantity NULLS FIRST, discount NULLS FIRST,
            tax NULLS FIRST, returnflag NULLS FIRST) AS rn FROM i)
        SELECT * EXCLUDE (rn) FROM r WHERE rn = 1""",
)
def dedup_by_key(spark, folder):
    return dedup.dedup_by_key(inputs.dirty_items(spark, folder), ("order_id", "line_no"))


@query(
    "dedup_by_key_collapse",
    f"""WITH {PART_CTE}, r AS (SELECT product_id, brand, name, row_number() OVER (
            PARTITION BY brand ORDER BY (name IS NULL)::INT, product_id, name) AS rn FROM p)
        SELECT product_id, brand, name FROM r WHERE rn = 1""",
)
def dedup_by_key_collapse(spark, folder):
    df = inputs.dirty_part(spark, folder).select("product_id", "brand", "name")
    return dedup.dedup_by_key(df, ("brand",), null_keys="collapse")


@query(
    "cleaning_plan",
    f"""WITH {ORDERS_CTE}, i AS ({DETECTED}), f AS (SELECT * FROM i WHERE affected_count > 0),
        s AS (
          SELECT 1 AS k, 'trim_whitespace' AS label, 'amount_text,order_date,status' AS fields,
                 'low' AS risk, 'strip_whitespace' AS transformation_type
          UNION ALL SELECT 2, 'parse_numeric_' || field, field, 'low', 'parse_currency_numeric'
            FROM f WHERE issue_type = 'currency_formats'
          UNION ALL SELECT 3, 'standardize_dates_' || field, field, 'medium', 'standardize_dates'
            FROM f WHERE issue_type = 'inconsistent_dates'
          UNION ALL SELECT 4, 'standardize_category_' || field, field, 'medium',
                 'standardize_categories'
            FROM (SELECT DISTINCT field FROM f WHERE field = 'status' AND issue_type
                  IN ('whitespace_case', 'suspicious_categories')) x
          UNION ALL SELECT 5, 'deduplicate_by_pk', field, 'high', 'deduplicate_by_pk'
            FROM f WHERE issue_type = 'duplicate_records' AND field IS NOT NULL)
        SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS step_no,
               'orders_step_' || lpad(CAST(row_number() OVER (ORDER BY k) AS VARCHAR), 2, '0')
                 || '_' || label AS step_id,
               fields, risk, transformation_type FROM s""",
)
def cleaning_plan(spark, folder):
    df = inputs.dirty_orders(spark, folder)
    found = issues.detect_issues(df, "orders").collect()  # a few rows per column
    planned = steps_frame(spark, build_steps(found, df, "orders"))
    return planned.select(
        "step_no",
        "step_id",
        F.array_join("affected_fields", ",").alias("fields"),
        "risk",
        "transformation_type",
    )


CLEANED = f"""SELECT DISTINCT order_id, customer_id, {sql.number('amount_text')} AS amount,
    {sql.iso_date('order_date', True)} AS order_date, {sql.title('status')} AS status FROM d"""


@query("clean_apply", f"WITH {ORDERS_CTE} {CLEANED}")
def clean_apply(spark, folder):
    clean, _, _ = plan_and_apply(inputs.dirty_orders(spark, folder), "orders")
    return clean.select(
        "order_id",
        "customer_id",
        F.col("amount_text").cast("decimal(30,6)").alias("amount"),
        "order_date",
        "status",
    )


@query(
    "clean_idempotent",
    f"""WITH {ORDERS_CTE}, c AS ({CLEANED})
        SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS changed_rows FROM c""",
)
def clean_idempotent(spark, folder):
    lazy, _, _ = plan_and_apply(inputs.dirty_orders(spark, folder), "orders")
    clean = stage(lazy, "orders-clean")
    again, _, _ = plan_and_apply(clean, "orders_clean")
    changed = dedup.differing_rows(clean, again).agg(F.count(F.lit(1)).alias("changed_rows"))
    counted = clean.agg(F.count(F.lit(1)).alias("row_count"))
    return counted.unionByName(changed, allowMissingColumns=True).agg(
        F.max("row_count").alias("row_count"), F.max("changed_rows").alias("changed_rows")
    )


@query(
    "clean_delta",
    f"""WITH {ORDERS_CTE}, c AS ({CLEANED}),
          n AS (SELECT (SELECT count(*) FROM d) AS b, count(*) AS a, count(DISTINCT order_id) AS k,
                  bool_and(status = {sql.title('status')}) AS titled FROM c)
        SELECT b AS rows_before, a AS rows_after, a - b AS row_delta,
               (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE SELECT order_id, customer_id, amount AS amount_text, order_date, status FROM c) x) AS columns_after,
               false AS schema_mutated, CASE WHEN a > k THEN 1 ELSE 0 END AS unresolved, titled AND a = k AS idempotent
        FROM n""",
)
def clean_delta(spark, folder):
    found = run_cleaning(inputs.dirty_orders(spark, folder), "orders").delta()
    return found.select(
        "rows_before",
        "rows_after",
        "row_delta",
        F.array_join(F.array_sort("schema_after"), ",").alias("columns_after"),
        "schema_mutated",
        F.size("unresolved_issues").alias("unresolved"),
        "idempotent",
    )


@query(
    "cleaning_run",
    f"""WITH {ORDERS_CTE}, c AS ({CLEANED})
        SELECT 'run' AS run_id, 'orders' AS dataset_name, (SELECT count(*) FROM d) AS rows_before,
               count(*) AS rows_after, count(*) AS rows_written, count(*) = count(DISTINCT order_id) AS idempotent FROM c""",
)
def cleaning_run(spark, folder):
    """A whole run with its files: raw and clean table, and the row about the run."""
    path = scratch_path(spark, "cleaning-run")
    run_cleaning(inputs.dirty_orders(spark, folder), "orders", out_dir=path, stage_input=True)
    meta = spark.read.json(f"{path}/orders_metadata.json")
    written = spark.read.parquet(f"{path}/orders_clean.parquet").agg(F.count(F.lit(1)).alias("rows_written"))
    both = meta.select("run_id", "dataset_name", "rows_before", "rows_after", "idempotent")
    return both.withColumn("rows_written", written.scalar())


def _least(value: str, test: str) -> str:
    return (
        f"(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {value} AS v FROM d WHERE {test} "
        "ORDER BY v LIMIT 3) s)"
    )


@query(
    "issue_samples",
    f"""WITH {ORDERS_CTE} SELECT * FROM (
          SELECT 'status' AS "column", 'whitespace' AS kind, {_least('status', PADDED.format(c='status'))} AS samples
          UNION ALL SELECT 'amount_text', 'currency_formats',
            {_least('amount_text', f"regexp_matches(amount_text, {CURRENCY})")}
          UNION ALL SELECT 'order_date', 'inconsistent_dates',
            {_least('order_date', f"regexp_matches(order_date, {SLASHED})")}) x""",
)
def issue_samples(spark, folder):
    """The three least distinct values that each rule flags."""
    wanted = [("status", "whitespace"), ("amount_text", "currency_formats"), ("order_date", "inconsistent_dates")]
    found = issues.flagged_samples(inputs.dirty_orders(spark, folder), wanted)
    return found.select("column", "kind", F.array_join("sample_values", "|").alias("samples"))


@query(
    "quality_report",
    f"""WITH {ORDERS_CTE}, {PART_CTE}, i AS ({DETECTED}),
        dates AS (SELECT order_id, {sql.iso_date('order_date', True)} AS x FROM d)
        SELECT 'orders' AS dataset, replace(id, 'orders_', '') AS "check", affected_count AS value,
               CASE severity WHEN 'high' THEN 'failed' ELSE 'warning' END AS status
          FROM (SELECT CASE id WHEN 'orders_order_id_duplicate_keys' THEN 'orders_id_duplicate_keys'
                       WHEN 'orders_order_date_inconsistent_dates' THEN 'orders_date_inconsistent_dates'
                       ELSE id END AS id, severity, affected_count FROM i WHERE affected_count > 0) y
          WHERE id NOT IN ('orders_id_duplicate_keys', 'orders_date_inconsistent_dates')
        UNION ALL SELECT 'orders', 'order_id_duplicate_keys', ({REPEATED_KEYS}), 'failed'
        UNION ALL SELECT 'orders', 'order_date_inconsistent_dates',
          count(*) FILTER (regexp_matches(order_date, {SLASHED})), 'failed' FROM d
        UNION ALL SELECT 'orders', 'row_count', count(*), 'ok' FROM d
        UNION ALL SELECT 'orders', 'column_count', 5, 'ok'
        UNION ALL SELECT 'orders', 'duplicate_row_count', ({REPEATED_ROWS}), 'ok'
        UNION ALL SELECT 'orders', 'rows_after', count(DISTINCT order_id), 'ok' FROM d
        UNION ALL SELECT 'orders', 'unresolved_high', 0, 'ok'
        UNION ALL SELECT 'orders', 'idempotent', 1, 'ok'
        UNION ALL SELECT 'customers', c, v, 'ok' FROM (
          SELECT 'row_count' AS c, count(*) AS v FROM customer
          UNION ALL SELECT 'column_count', 5 UNION ALL SELECT 'duplicate_row_count', 0
          UNION ALL SELECT 'rows_after', count(*) FROM customer
          UNION ALL SELECT 'unresolved_high', 0 UNION ALL SELECT 'idempotent', 1) z""",
)
def quality_report(spark, folder):
    return reports.quality_report(
        {"orders": inputs.dirty_orders(spark, folder), "customers": table(spark, folder, "customer")}
    )


@query(
    "raw_vs_clean",
    f"""WITH {ORDERS_CTE}, c AS ({CLEANED}), q AS (
          SELECT 'raw' AS version, status, {sql.number('amount_text', 'DECIMAL(18,2)')} AS a FROM d
          UNION ALL SELECT 'clean', status, amount FROM c)
        SELECT version, status, CAST(count(*) AS BIGINT) AS order_count,
               {sql.round2('coalesce(sum(a), 0)')} AS total FROM q GROUP BY 1, 2""",
)
def raw_vs_clean(spark, folder):
    df = inputs.dirty_orders(spark, folder)
    clean, _, _ = plan_and_apply(df, "orders")
    spec = {
        "dataset": "orders",
        "group_by": ["status"],
        "metrics": [
            {"agg": "count", "field": "*", "alias": "order_count"},
            {"agg": "sum", "field": "amount_text", "alias": "total"},
        ],
        "limit": 100,
    }
    return reports.raw_beside_clean({"orders": df}, {"orders": clean}, spec)
