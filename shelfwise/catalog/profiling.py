"""Sources, sinks and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.catalog import inputs, sql
from shelfwise.catalog.inputs import table
from shelfwise.catalog.registry import query
from shelfwise.operators import frequency, profiling
from shelfwise.plans.cleaning_plan import apply_steps, build_steps
from shelfwise.plans.declared_query import evidence
from shelfwise.operators.issues import detect_issues
from shelfwise.roles import has_role
from shelfwise.session import scratch_path
from shelfwise.sources import tables


@query(
    "scan_csv",
    """SELECT o_orderkey AS order_id, o_orderstatus AS status, o_orderpriority AS priority,
              CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders""",
)
def scan_csv(spark, folder):
    path = scratch_path(spark, "orders-csv")
    tables.write_csv(table(spark, folder, "orders"), path)
    read = tables.read_csv(spark, path)
    return read.select(
        F.col("o_orderkey").cast("bigint").alias("order_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
    )


@query(
    "clean_roundtrip",
    f"""WITH c AS (SELECT DISTINCT order_id, {sql.number('amount_text')} AS amount
                   FROM ({inputs.DIRTY_ORDERS}) d)
        SELECT count(*) AS row_count, count(amount) AS amounts,
               CAST(sum(amount) AS DECIMAL(38,2)) AS total FROM c""",
)
def clean_roundtrip(spark, folder):
    df = inputs.dirty_orders(spark, folder)
    issues = detect_issues(df, "orders").collect()
    clean, _ = apply_steps(df, build_steps(issues, df, "orders"))
    path = scratch_path(spark, "orders-clean-csv")
    tables.write_csv(clean, path)
    read = tables.read_csv(spark, path)
    amount = F.col("amount_text").cast("decimal(18,4)")
    return read.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(amount).alias("amounts"),
        F.sum(amount).cast("decimal(38,2)").alias("total"),
    )


@query("profile_json")
def profile_json(spark, folder):
    path = scratch_path(spark, "profile-json")
    tables.write_metadata(profiling.profile(table(spark, folder, "part")), path)
    return spark.read.json(path)


@query(
    "preview_rows",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, {sql.round2('o_totalprice')} AS o_totalprice,
               CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
        FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""",
)
def preview_rows(spark, folder):
    return tables.preview(table(spark, folder, "orders"), [F.desc("o_totalprice"), "o_orderkey"])


CATALOG_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


@query(
    "dataset_catalog",
    " UNION ALL ".join(
        f"SELECT '{t}_raw' AS name, count(*) AS \"rows\", "
        f"(SELECT count(*) FROM (DESCRIBE {t}) x) AS column_count, "
        f"false AS is_clean, true AS is_raw FROM {t}"
        for t in CATALOG_TABLES
    ),
)
def dataset_catalog(spark, folder):
    found = tables.catalog({f"{t}_raw": table(spark, folder, t) for t in CATALOG_TABLES})
    return found.select(
        "name", "rows", F.size("columns").cast("bigint").alias("column_count"), "is_clean", "is_raw"
    )


@query(
    "audit_append",
    f"""SELECT CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS turn, 's1' AS session_id,
          'o_orderstatus eq ' || o_orderstatus AS filters, count(*) AS rows_considered, CAST(1 AS BIGINT) AS rows_returned,
          'LOAD orders (' || (SELECT count(*) FROM orders) || ' rows)' AS first_step,
          {sql.round2('sum(CAST(o_totalprice AS DECIMAL(18,2)))')} AS total
        FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus""",
)
def audit_append(spark, folder):
    path = scratch_path(spark, "audit")
    loaded = {"orders": table(spark, folder, "orders")}
    # The first turn is appended twice, as by a caller that tries again.
    for turn, status in ((1, "F"), (2, "O"), (1, "F")):
        spec = {
            "dataset": "orders",
            "filters": [{"field": "o_orderstatus", "op": "eq", "value": status}],
            "metrics": [{"agg": "sum", "field": "o_totalprice", "alias": "total"}],
        }
        tables.append_audit(evidence(loaded, spec), path, "s1", turn)
    return tables.session_history(spark, path, "s1").select(
        "turn", "session_id", F.array_join("filters", ",").alias("filters"), "rows_considered", "rows_returned",
        F.col("operations")[0].alias("first_step"),
        F.get_json_object(F.col("preview")[0], "$.total").cast("double").alias("total"),
    )


@query(
    "profile_table",
    f"""SELECT 'orders' AS dataset, count(*) AS row_count, CAST(5 AS BIGINT) AS column_count,
               count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({inputs.DIRTY_ORDERS}) d))
                 AS duplicate_row_count
        FROM ({inputs.DIRTY_ORDERS}) d""",
)
def profile_table(spark, folder):
    return profiling.table_profile(inputs.dirty_orders(spark, folder), "orders")


@query(
    "profile_duplicates",
    f"""WITH d AS ({inputs.DIRTY_ORDERS}), u AS (SELECT DISTINCT * FROM d)
        SELECT (SELECT count(*) FROM d) AS row_count, (SELECT count(*) FROM u) AS distinct_row_count,
               (SELECT count(*) FROM d) - (SELECT count(*) FROM u) AS duplicate_row_count""",
)
def profile_duplicates(spark, folder):
    return frequency.duplicate_row_count(inputs.dirty_orders(spark, folder))


PART_COLUMNS = ("product_id", "sku", "name", "category", "brand", "price", "note", "stock")


@query(
    "profile_nulls",
    f"WITH d AS ({inputs.DIRTY_PART}) "
    + sql.per_column(
        PART_COLUMNS,
        lambda c: f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count,
            {sql.round2(f"(count(*) - count({c}))::DOUBLE * 100 / count(*)")} AS null_percentage
            FROM d""",
    ),
)
def profile_nulls(spark, folder):
    return profiling.null_counts(inputs.dirty_part(spark, folder))


ORDER_COLUMNS = (
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
)


@query(
    "profile_cardinality",
    sql.per_column(
        ORDER_COLUMNS,
        lambda c: f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_count,
            CAST(round(CAST(count(DISTINCT {c})::DOUBLE / count(*) AS DECIMAL(28,8)), 4) AS DOUBLE)
              AS cardinality_ratio,
            count(DISTINCT {c}) = count(*) AND count({c}) = count(*) AS is_unique
            FROM orders""",
    ),
)
def profile_cardinality(spark, folder):
    return profiling.cardinality(table(spark, folder, "orders"))


@query("profile_cardinality_approx")
def profile_cardinality_approx(spark, folder):
    return profiling.cardinality(table(spark, folder, "orders"), approx=True)


def _type_sql(source: str, dataset: str, column: str) -> str:
    named = {r: str(has_role(column, r)).lower() for r in ("identifier", "currency", "date")}
    date = sql.iso_date(f"CAST({column} AS VARCHAR)")
    return f"""SELECT '{dataset}' AS dataset, '{column}' AS "column",
        CASE WHEN count({column}) = 0 THEN 'empty'
             WHEN {named['identifier']} THEN 'identifier'
             WHEN count(*) FILTER (lower(trim(CAST({column} AS VARCHAR))) IN {sql.BOOLEANS})
                  = count({column}) THEN 'boolean'
             WHEN count({sql.number(column)}) = count({column})
                  THEN CASE WHEN {named['currency']} THEN 'currency' ELSE 'numeric' END
             WHEN {named['date']} AND count({date}) = count({column}) THEN 'datetime'
             WHEN count(DISTINCT {column})::DOUBLE / count({column}) < 0.2
                  OR count(DISTINCT {column}) <= 30 THEN 'categorical'
             ELSE 'text' END AS inferred_type
        FROM {source}"""


DIRTY_ORDER_COLUMNS = ("order_id", "customer_id", "amount_text", "order_date", "status")
TYPED_PART_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query(
    "infer_types",
    f"WITH d AS ({inputs.DIRTY_ORDERS}), q AS ({inputs.DIRTY_PART}) "
    + " UNION ALL ".join(
        [_type_sql("d", "orders", c) for c in DIRTY_ORDER_COLUMNS]
        + [_type_sql("part", "part", c) for c in TYPED_PART_COLUMNS]
        + [_type_sql("q", "products", c) for c in PART_COLUMNS]
    ),
)
def infer_types(spark, folder):
    sources = {
        "orders": inputs.dirty_orders(spark, folder),
        "part": table(spark, folder, "part"),
        "products": inputs.dirty_part(spark, folder),
    }
    found = None
    for name, df in sources.items():
        typed = profiling.infer_types(df).withColumn("dataset", F.lit(name))
        found = typed if found is None else found.unionByName(typed)
    return found


NUMERIC_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query(
    "profile_numeric",
    sql.per_column(
        NUMERIC_COLUMNS,
        lambda c: f"""SELECT '{c}' AS "column", {sql.round2(f'min({c})')} AS "min",
            {sql.round2(f'max({c})')} AS "max", {sql.round2(f'avg({c})')} AS mean,
            {sql.round2(f'quantile_cont({c}, 0.5)')} AS median,
            {sql.round2(f'stddev_samp({c})')} AS std,
            {sql.round2(f'quantile_cont({c}, 0.25)')} AS q25,
            {sql.round2(f'quantile_cont({c}, 0.75)')} AS q75 FROM lineitem""",
    ),
)
def profile_numeric(spark, folder):
    return profiling.numeric_stats(table(spark, folder, "lineitem"), NUMERIC_COLUMNS)


@query(
    "profile_datetime",
    f"""SELECT 'ts' AS "column", strftime(min(ts), '%Y-%m-%d') AS min_date,
               strftime(max(ts), '%Y-%m-%d') AS max_date FROM events
        UNION ALL
        SELECT 'order_date', min({sql.iso_date('order_date')}), max({sql.iso_date('order_date')})
        FROM ({inputs.DIRTY_ORDERS}) d""",
)
def profile_datetime(spark, folder):
    events = profiling.datetime_ranges(table(spark, folder, "events"), ["ts"])
    dirty = profiling.datetime_ranges(inputs.dirty_orders(spark, folder), ["order_date"])
    return events.unionByName(dirty)


_COUNTED = """WITH v AS (
    SELECT 'p_name' AS "column", p_name AS value, count(*) AS n FROM part GROUP BY p_name
    UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY p_brand
    UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type)"""


@query(
    "profile_top_values",
    f"""{_COUNTED} SELECT "column", value, n, CAST(position AS INTEGER) AS position FROM (
        SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS position
        FROM v) r WHERE position <= 5""",
)
def profile_top_values(spark, folder):
    counts = frequency.value_counts(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"])
    return frequency.top_values(counts)


@query(
    "profile_samples",
    f"""{_COUNTED} SELECT "column", CAST(position AS INTEGER) AS position, value FROM (
        SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) AS position
        FROM v) r WHERE position <= 5""",
)
def profile_samples(spark, folder):
    counts = frequency.value_counts(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"])
    return frequency.sample_values(counts)


@query(
    "profile_parse_failures",
    f"""WITH d AS ({inputs.DIRTY_ORDERS})
        SELECT 'amount_text' AS "column",
               count(*) FILTER (amount_text IS NOT NULL AND {sql.number('amount_text')} IS NULL)
                 AS parse_failures FROM d
        UNION ALL
        SELECT 'order_date',
               count(*) FILTER (order_date IS NOT NULL AND {sql.iso_date('order_date')} IS NULL) FROM d""",
)
def profile_parse_failures(spark, folder):
    return profiling.parse_failures(
        inputs.dirty_orders(spark, folder), ["amount_text"], ["order_date"]
    )


def _full_sql(column: str) -> str:
    x, date = sql.number(column, "DOUBLE"), sql.iso_date(f"CAST({column} AS VARCHAR)")
    kind = f"(SELECT inferred_type FROM t WHERE t.\"column\" = '{column}')"
    stat = lambda e: f"CASE WHEN {kind} IN ('numeric','currency') THEN {sql.round2(e)} END"
    when_date = lambda e: f"CASE WHEN {kind} = 'datetime' THEN {e} END"
    return f"""SELECT '{column}' AS "column", {kind} AS inferred_type,
        count(*) - count({column}) AS null_count,
        {sql.round2(f"(count(*) - count({column}))::DOUBLE * 100 / count(*)")} AS null_percentage,
        count(DISTINCT {column}) AS distinct_count,
        CAST(round(CAST(count(DISTINCT {column})::DOUBLE / count(*) AS DECIMAL(28,8)), 4) AS DOUBLE)
          AS cardinality_ratio,
        count(DISTINCT {column}) = count(*) AND count({column}) = count(*) AS is_unique,
        {stat(f'min({x})')} AS "min", {stat(f'max({x})')} AS "max", {stat(f'avg({x})')} AS mean,
        {stat(f'quantile_cont({x}, 0.5)')} AS median, {stat(f'stddev_samp({x})')} AS std,
        {stat(f'quantile_cont({x}, 0.25)')} AS q25, {stat(f'quantile_cont({x}, 0.75)')} AS q75,
        {when_date(f'min({date})')} AS min_date, {when_date(f'max({date})')} AS max_date,
        CASE WHEN {kind} IN ('numeric','currency') THEN count({column}) - count({x})
             WHEN {kind} = 'datetime' THEN count({column}) - count({date}) ELSE 0 END
          AS parse_failures
        FROM d"""


@query(
    "profile_full",
    f"WITH d AS ({inputs.DIRTY_ORDERS}), t AS ("
    + " UNION ALL ".join(_type_sql("d", "orders", c) for c in DIRTY_ORDER_COLUMNS)
    + ") "
    + sql.per_column(DIRTY_ORDER_COLUMNS, _full_sql),
)
def profile_full(spark, folder):
    found = profiling.profile(inputs.dirty_orders(spark, folder))
    return found.drop("sample_values", "top_frequencies")


@query("profile_approx")
def profile_approx(spark, folder):
    return profiling.profile(inputs.dirty_orders(spark, folder), approx=True)




@query(
    "load_map",
    "SELECT 'nation' AS name, count(*) AS \"rows\", max(n_name) AS last FROM nation "
    "UNION ALL SELECT 'region', count(*), max(r_name) FROM region",
)
def load_map(spark, folder):
    """Named paths to tables; the one that is missing is left out."""
    paths = {t: f"{folder}/{t}.parquet" for t in ("nation", "region")} | {"gone": f"{folder}/no_such_table.parquet"}
    loaded = tables.read_tables(spark, paths)
    parts = [
        df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.max(f"{name[0]}_name").alias("last"))
        for name, df in loaded.items()
    ]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


@query(
    "folder_scan",
    "SELECT 'nation' AS name, count(*) AS \"rows\", (SELECT count(*) FROM (DESCRIBE nation) x) AS column_count FROM nation "
    "UNION ALL SELECT 'supplier', count(*), (SELECT count(*) FROM (DESCRIBE supplier) x) FROM supplier",
)
def folder_scan(spark, folder):
    """A folder of CSV tables, each found by its name."""
    path = scratch_path(spark, "csv-folder")
    for name in ("nation", "supplier"):
        tables.write_csv(table(spark, folder, name), f"{path}/{name}.csv")
    found = tables.catalog(tables.read_folder(spark, path))
    return found.select("name", "rows", F.size("columns").cast("bigint").alias("column_count"))


@query(
    "raw_and_clean_views",
    """SELECT 'orders_raw' AS name, count(*) AS "rows" FROM orders
       UNION ALL SELECT 'orders_clean', count(*) FROM orders WHERE o_orderstatus <> 'P'""",
)
def raw_and_clean_views(spark, folder):
    df = table(spark, folder, "orders")
    tables.register_versions("orders", df, df.where("o_orderstatus <> 'P'"))
    parts = [
        spark.table(name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        for name in ("orders_raw", "orders_clean")
    ]
    return parts[0].unionByName(parts[1])
