"""Filters, aggregates, sorting and declared queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.catalog import inputs, sql
from shelfwise.catalog.inputs import table
from shelfwise.catalog.registry import query
from shelfwise.functions.numbers import number_of
from shelfwise.functions.text import round2
from shelfwise.operators import filters
from shelfwise.plans import declared_query
from shelfwise.plans import quality_report as reports

ORDERS_CTE = f"d AS ({inputs.DIRTY_ORDERS})"


def _keep(df: DataFrame, *tests) -> DataFrame:
    return reduce(DataFrame.where, [filters.predicate(df, *t) for t in tests], df)


@query("filter_eq", f"WITH {ORDERS_CTE} SELECT * FROM d WHERE lower(status) = 'returned'")
def filter_eq(spark, folder):
    return _keep(inputs.dirty_orders(spark, folder), ("status", "eq", "RETURNED"))


@query(
    "filter_neq",
    f"""WITH p AS ({inputs.DIRTY_PART}) SELECT product_id, brand FROM p
        WHERE brand IS NULL OR lower(brand) <> 'brand#1'""",
)
def filter_neq(spark, folder):
    df = inputs.dirty_part(spark, folder).select("product_id", "brand")
    return _keep(df, ("brand", "neq", "Brand#1"))


@query(
    "filter_range",
    f"""WITH {ORDERS_CTE} SELECT order_id, amount_text FROM d
        WHERE {sql.number('amount_text', 'DOUBLE')} > 100000
          AND {sql.number('amount_text', 'DOUBLE')} <= 250000.5""",
)
def filter_range(spark, folder):
    df = inputs.dirty_orders(spark, folder).select("order_id", "amount_text")
    return _keep(df, ("amount_text", "gt", 100000), ("amount_text", "lte", "250000.5"))


@query(
    "filter_range_typed",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
       WHERE l_quantity >= 10 AND l_quantity < 40 AND l_discount > 0.05 AND l_orderkey <= 9000""",
)
def filter_range_typed(spark, folder):
    df = table(spark, folder, "lineitem")
    kept = _keep(
        df,
        ("l_quantity", "gte", 10),
        ("l_quantity", "lt", 40),
        ("l_discount", ">", 0.05),
        ("l_orderkey", "<=", 9000),
    )
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query(
    "filter_in",
    """SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders
       WHERE lower(o_orderstatus) IN ('f', 'p') AND o_custkey IN (1, 2, 3, 5, 8, 13, 21)""",
)
def filter_in(spark, folder):
    df = table(spark, folder, "orders")
    kept = _keep(
        df, ("o_orderstatus", "in", ["f", "P"]), ("o_custkey", "in", [1, 2, 3, 5, 8, 13, 21])
    )
    return kept.select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query(
    "filter_contains",
    """SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')""",
)
def filter_contains(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_name")
    return _keep(df, ("p_name", "contains", "RED"))


@query(
    "filter_contains_regex",
    """SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^(red|hot) .*ring$')""",
)
def filter_contains_regex(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_name")
    return _keep(df, ("p_name", "contains", "^(red|hot) .*RING$", True))


@query(
    "filter_nulls",
    f"""WITH i AS ({inputs.DIRTY_ITEMS}) SELECT order_id, line_no, discount, tax FROM i
        WHERE discount IS NULL AND tax IS NOT NULL""",
)
def filter_nulls(spark, folder):
    df = inputs.dirty_items(spark, folder).select("order_id", "line_no", "discount", "tax")
    return _keep(df, ("discount", "is_null"), ("tax", "not_null"))


@query(
    "filter_funnel",
    """SELECT 0 AS step, 'all rows' AS filter, count(*) AS remaining FROM orders
       UNION ALL SELECT 1, 'o_orderstatus eq F', count(*) FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT 2, 'o_totalprice gt 150000', count(*) FROM orders
         WHERE o_orderstatus = 'F' AND o_totalprice > 150000
       UNION ALL SELECT 3, 'o_orderpriority contains urgent', count(*) FROM orders
         WHERE o_orderstatus = 'F' AND o_totalprice > 150000
           AND contains(lower(o_orderpriority), 'urgent')""",
)
def filter_funnel(spark, folder):
    return filters.filter_funnel(
        table(spark, folder, "orders"),
        [
            {"field": "o_orderstatus", "op": "eq", "value": "F"},
            {"field": "o_totalprice", "op": "gt", "value": 150000},
            {"field": "o_orderpriority", "op": "contains", "value": "urgent"},
        ],
    )


@query(
    "coerce_numeric",
    f"WITH {ORDERS_CTE} SELECT order_id, {sql.number('amount_text', 'DOUBLE')} AS amount FROM d",
)
def coerce_numeric(spark, folder):
    df = inputs.dirty_orders(spark, folder)
    return df.select("order_id", number_of(df, "amount_text").alias("amount"))


def _metrics(*metrics):
    return [{"agg": a, "field": f, "alias": n} for a, f, n in metrics]


def _rounded(df, *columns):
    return df.withColumns({c: round2(F.col(c)).cast("double") for c in columns})


@query(
    "agg_sum",
    f"""WITH {ORDERS_CTE} SELECT status,
          {sql.round2(f"sum(coalesce({sql.number('amount_text', 'DECIMAL(18,2)')}, 0))")} AS total
        FROM d GROUP BY status""",
)
def agg_sum(spark, folder):
    found = filters.grouped(
        inputs.dirty_orders(spark, folder), ["status"], _metrics(("sum", "amount_text", "total"))
    )
    return _rounded(found, "total")


@query(
    "agg_avg",
    f"""WITH {ORDERS_CTE} SELECT customer_id,
          {sql.round2(f"CAST(sum({sql.number('amount_text', 'DECIMAL(18,2)')}) AS DOUBLE) / count({sql.number('amount_text')})")}
            AS average FROM d GROUP BY customer_id""",
)
def agg_avg(spark, folder):
    found = filters.grouped(
        inputs.dirty_orders(spark, folder), ["customer_id"],
        _metrics(("mean", "amount_text", "average")),
    )
    return _rounded(found, "average")


@query(
    "agg_min_max",
    """SELECT l_returnflag, l_linestatus, min(l_extendedprice) AS least, max(l_extendedprice) AS most
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def agg_min_max(spark, folder):
    return filters.grouped(
        table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"],
        _metrics(("min", "l_extendedprice", "least"), ("max", "l_extendedprice", "most")),
    )


@query(
    "agg_count",
    f"""WITH i AS ({inputs.DIRTY_ITEMS}) SELECT returnflag, count(discount) AS discounts,
          count(tax) AS taxes FROM i GROUP BY returnflag""",
)
def agg_count(spark, folder):
    return filters.grouped(
        inputs.dirty_items(spark, folder), ["returnflag"],
        _metrics(("count", "discount", "discounts"), ("count", "tax", "taxes")),
    )


@query(
    "agg_count_distinct",
    f"""WITH p AS ({inputs.DIRTY_PART}) SELECT category, count(DISTINCT brand) AS brands
        FROM p GROUP BY category""",
)
def agg_count_distinct(spark, folder):
    return filters.grouped(
        inputs.dirty_part(spark, folder), ["category"], _metrics(("unique", "brand", "brands"))
    )


@query(
    "agg_distinct",
    f"WITH p AS ({inputs.DIRTY_PART}) SELECT DISTINCT brand, category FROM p",
)
def agg_distinct(spark, folder):
    return filters.grouped(inputs.dirty_part(spark, folder), ["brand", "category"], [])


@query(
    "agg_null_groups",
    f"""WITH p AS ({inputs.DIRTY_PART}) SELECT brand, count(*) AS products, true AS kept FROM p GROUP BY brand
        UNION ALL SELECT brand, count(*), false FROM p WHERE brand IS NOT NULL GROUP BY brand""",
)
def agg_null_groups(spark, folder):
    df = inputs.dirty_part(spark, folder)
    counted = _metrics(("count", "*", "products"))
    kept = filters.grouped(df, ["brand"], counted, keep_null_groups=True)
    dropped = filters.grouped(df, ["brand"], counted)
    return kept.withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False)))


@query(
    "agg_global_counts",
    f"""WITH i AS ({inputs.DIRTY_ITEMS}) SELECT count(*) AS line_count, count(discount) AS discounts,
          count(DISTINCT product_id) AS products FROM i""",
)
def agg_global_counts(spark, folder):
    return filters.totals(
        inputs.dirty_items(spark, folder),
        _metrics(
            ("count", "*", "line_count"),
            ("count", "discount", "discounts"),
            ("count_distinct", "product_id", "products"),
        ),
    )


GLOBAL = _metrics(
    ("sum", "o_totalprice", "total"), ("avg", "o_totalprice", "average"),
    ("min", "o_totalprice", "least"), ("max", "o_totalprice", "most"),
)
_GLOBAL_SQL = f"""SELECT {{label}} AS part,
    {sql.round2('coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0)')} AS total,
    {sql.round2('coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 0)')} AS average,
    {sql.round2('min(o_totalprice)')} AS least, {sql.round2('max(o_totalprice)')} AS most
    FROM orders"""


@query(
    "agg_global",
    _GLOBAL_SQL.format(label="'all'")
    + " UNION ALL "
    + _GLOBAL_SQL.format(label="'none'")
    + " WHERE o_totalprice < 0",
)
def agg_global(spark, folder):
    df = table(spark, folder, "orders")
    every = filters.totals(df, GLOBAL).withColumn("part", F.lit("all"))
    none = filters.totals(df.where("o_totalprice < 0"), GLOBAL).withColumn("part", F.lit("none"))
    return every.unionByName(none)


@query(
    "agg_multi",
    f"""SELECT l_returnflag, l_linestatus,
          {sql.round2('sum(CAST(l_quantity AS DECIMAL(18,2)))')} AS sum_l_quantity,
          {sql.round2('sum(CAST(l_extendedprice AS DECIMAL(18,2)))')} AS revenue,
          {sql.round2('CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*)')} AS avg_l_discount,
          count(*) AS line_count, count(DISTINCT l_suppkey) AS suppliers
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def agg_multi(spark, folder):
    found = filters.grouped(
        table(spark, folder, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        [
            {"agg": "sum", "field": "l_quantity"},
            {"agg": "total", "field": "l_extendedprice", "alias": "revenue"},
            {"agg": "average", "field": "l_discount"},
            {"agg": "count", "field": "*", "alias": "line_count"},
            {"agg": "distinct_count", "field": "l_suppkey", "alias": "suppliers"},
        ],
    )
    return _rounded(found, "sum_l_quantity", "revenue", "avg_l_discount")


@query("agg_count_star", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def agg_count_star(spark, folder):
    return filters.grouped(
        table(spark, folder, "orders"), ["o_orderpriority"], _metrics(("count", "*", "n"))
    )


@query(
    "sort_multi",
    f"""WITH p AS (SELECT brand, stock, product_id FROM ({inputs.DIRTY_PART}) x)
        SELECT 'asc' AS way, * FROM (SELECT * FROM p
          ORDER BY brand ASC NULLS LAST, stock DESC NULLS LAST, product_id LIMIT 100) a
        UNION ALL SELECT 'desc', * FROM (SELECT * FROM p
          ORDER BY brand DESC NULLS LAST, stock DESC NULLS LAST, product_id LIMIT 100) b""",
)
def sort_multi(spark, folder):
    df = inputs.dirty_part(spark, folder).select("brand", "stock", "product_id")
    parts = []
    for way in ("asc", "desc"):
        sort = [
            {"field": "brand", "dir": way},
            {"field": "stock", "dir": "sideways"},
            {"field": "no_such_field", "dir": "asc"},
        ]
        head = df.orderBy(*filters.sort_columns(df, sort)).limit(100)
        parts.append(head.withColumn("way", F.lit(way)))
    return parts[0].unionByName(parts[1])


@query(
    "limit_clamp",
    """SELECT 1000000 AS asked, count(*) AS returned FROM (SELECT * FROM orders LIMIT 100) a
       UNION ALL SELECT 0, count(*) FROM (SELECT * FROM orders LIMIT 10) b
       UNION ALL SELECT 7, count(*) FROM (SELECT * FROM orders LIMIT 7) c""",
)
def limit_clamp(spark, folder):
    df = table(spark, folder, "orders")
    parts = [
        df.limit(filters.clamp_limit(asked)).agg(
            F.lit(asked).alias("asked"), F.count(F.lit(1)).alias("returned")
        )
        for asked in (1_000_000, 0, 7)
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "top_k",
    f"""SELECT o_custkey, {sql.round2('sum(CAST(o_totalprice AS DECIMAL(18,2)))')} AS spend
        FROM orders GROUP BY o_custkey ORDER BY spend DESC, o_custkey LIMIT 15""",
)
def top_k(spark, folder):
    spec = {
        "dataset": "orders",
        "group_by": ["o_custkey"],
        "metrics": [{"agg": "sum", "field": "o_totalprice", "alias": "spend"}],
        "sort": [{"field": "spend", "dir": "desc"}],
        "limit": 15,
    }
    return declared_query.run_query({"orders": table(spark, folder, "orders")}, spec)


@query(
    "query_spec_all",
    f"""SELECT o_custkey, {sql.round2('sum(CAST(o_totalprice AS DECIMAL(18,2)))')} AS spend, count(*) AS n
        FROM orders GROUP BY o_custkey""",
)
def query_spec_all(spark, folder):
    """No limit in the description: every group comes back."""
    spec = {
        "dataset": "orders",
        "group_by": ["o_custkey"],
        "metrics": [
            {"agg": "sum", "field": "o_totalprice", "alias": "spend"},
            {"agg": "count", "field": "*", "alias": "n"},
        ],
    }
    return declared_query.run_query({"orders": table(spark, folder, "orders")}, spec)


def _commerce(spark, folder):
    return {
        "orders": inputs.orders(spark, folder),
        "items": inputs.items(spark, folder),
        "products": inputs.products(spark, folder),
    }


CATEGORY_SPEC = {
    "dataset": "items",
    "joins": [
        {"dataset": "products", "left_on": "product_id", "right_on": "product_id", "how": "inner"},
        {"dataset": "orders", "left_on": "order_id", "right_on": "order_id", "how": "inner"},
    ],
    "filters": [
        {"field": "status", "op": "!=", "value": "returned"},
        {"field": "quantity", "op": ">=", "value": 10},
    ],
    "group_by": ["category"],
    "metrics": [
        {"agg": "total", "field": "amount", "alias": "total_sales"},
        {"agg": "unique", "field": "customer_id", "alias": "customers"},
        {"agg": "count", "field": "*", "alias": "line_count"},
    ],
    "sort": [{"field": "total_sales", "dir": "desc"}],
    "limit": 100,
}
_JOINED = f"""FROM ({inputs.ITEMS}) i JOIN ({inputs.PRODUCTS}) p ON i.product_id = p.product_id
    JOIN ({inputs.ORDERS}) o ON i.order_id = o.order_id"""


@query(
    "query_spec",
    f"""SELECT category, {sql.round2('sum(CAST(amount AS DECIMAL(18,2)))')} AS total_sales,
          count(DISTINCT customer_id) AS customers, count(*) AS line_count {_JOINED}
        WHERE lower(status) <> 'returned' AND quantity >= 10 GROUP BY category""",
)
def query_spec(spark, folder):
    return declared_query.run_query(_commerce(spark, folder), CATEGORY_SPEC)


FILTER_SPEC = {
    "dataset": "orders",
    "filters": [
        {"field": "status", "op": "equals", "value": "completed"},
        {"field": "priority", "op": "in", "value": ["1-urgent", "2-HIGH"]},
        {"field": "total_amount", "op": ">", "value": 1000},
    ],
    "sort": [{"field": "total_amount", "dir": "desc"}],
}


@query(
    "query_spec_filter",
    f"""SELECT order_id, customer_id, {sql.round2('total_amount')} AS total_amount,
          CAST(order_date AS VARCHAR) AS order_date, priority, status FROM ({inputs.ORDERS}) o
        WHERE lower(status) = 'completed' AND lower(priority) IN ('1-urgent', '2-high')
          AND total_amount > 1000""",
)
def query_spec_filter(spark, folder):
    return declared_query.run_query(_commerce(spark, folder), FILTER_SPEC)


TOTALS_SPEC = {
    "dataset": "items",
    "filters": [{"field": "returned", "op": "eq", "value": True}],
    "metrics": [
        {"agg": "sum", "field": "amount"},
        {"agg": "average", "field": "quantity", "alias": "average_quantity"},
        {"agg": "count", "field": "*", "alias": "line_count"},
    ],
}


@query(
    "query_spec_totals",
    f"""SELECT {sql.round2('sum(CAST(amount AS DECIMAL(18,2)))')} AS sum_amount,
          {sql.round2('CAST(sum(CAST(quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*)')} AS average_quantity,
          count(*) AS line_count FROM ({inputs.ITEMS}) i WHERE returned""",
)
def query_spec_totals(spark, folder):
    return declared_query.run_query(_commerce(spark, folder), TOTALS_SPEC)


_EVIDENCE_SQL = f"""
WITH i AS ({inputs.ITEMS}), p AS ({inputs.PRODUCTS}), o AS ({inputs.ORDERS}),
  ip AS (SELECT i.*, p.category FROM i JOIN p ON i.product_id = p.product_id),
  ipo AS (SELECT ip.*, o.status, o.customer_id FROM ip JOIN o ON ip.order_id = o.order_id),
  k AS (SELECT * FROM ipo WHERE lower(status) <> 'returned' AND quantity >= 10),
  g AS (SELECT category, {sql.round2('sum(CAST(amount AS DECIMAL(18,2)))')} AS s,
          count(DISTINCT customer_id) AS customers FROM k GROUP BY category),
  n AS (SELECT (SELECT count(*) FROM i) AS i, (SELECT count(*) FROM ip) AS ip,
          (SELECT count(*) FROM ipo) AS ipo, (SELECT count(*) FROM g) AS g, (SELECT count(*) FROM k) AS k,
          (SELECT count(*) FROM ipo WHERE lower(status) <> 'returned') AS a)
SELECT 'items' AS dataset, k AS rows_considered, g AS rows_returned, g AS previewed,
  'FILTER status != returned (' || a || ' rows left)' AS first_filter,
  'FILTER quantity >= 10 (' || k || ' rows left)' AS second_filter,
  'LIMIT 100 (' || g || ' rows returned)' AS last_step,
  ip AS first_join_rows, ipo AS second_join_rows,
  {sql.ratio2('ipo', 'ip').replace('DECIMAL(18,2))', 'DOUBLE)')} AS second_fanout, ipo > 1.5 * ip AS second_warning,
  (SELECT category FROM g ORDER BY s DESC, category LIMIT 1) AS top_category,
  (SELECT CAST(customers AS VARCHAR) FROM g ORDER BY s DESC, category LIMIT 1) AS top_customers
FROM n
"""


@query("query_evidence", _EVIDENCE_SQL)
def query_evidence(spark, folder):
    found = declared_query.evidence(_commerce(spark, folder), CATEGORY_SPEC)
    first, second = F.col("joins")[0], F.col("joins")[1]
    return found.select(
        "dataset",
        "rows_considered",
        "rows_returned",
        F.size("preview").cast("bigint").alias("previewed"),
        F.col("operations")[3].alias("first_filter"),
        F.col("operations")[4].alias("second_filter"),
        F.element_at("operations", -1).alias("last_step"),
        first["rows_joined"].cast("bigint").alias("first_join_rows"),
        second["rows_joined"].cast("bigint").alias("second_join_rows"),
        second["fanout_ratio"].alias("second_fanout"),
        second["fanout_warning"].alias("second_warning"),
        F.get_json_object(F.col("preview")[0], "$.category").alias("top_category"),
        F.get_json_object(F.col("preview")[0], "$.customers").alias("top_customers"),
    )


@query(
    "query_evidence_scalar",
    f"""SELECT count(*) AS rows_considered, CAST(1 AS BIGINT) AS rows_returned,
          CAST(count(*) AS VARCHAR) AS scalar_answer, 'LIMIT none (1 rows returned)' AS last_step,
          CAST(0 AS BIGINT) AS joins
        FROM ({inputs.ITEMS}) i WHERE returned""",
)
def query_evidence_scalar(spark, folder):
    spec = {**TOTALS_SPEC, "metrics": TOTALS_SPEC["metrics"][2:]}
    return declared_query.evidence(_commerce(spark, folder), spec).select(
        "rows_considered", "rows_returned", "scalar_answer",
        F.element_at("operations", -1).alias("last_step"), F.size("joins").cast("bigint").alias("joins"),
    )


_PLAIN = "regexp_replace(CAST(CAST({x} AS DECIMAL(38,2)) AS VARCHAR), '0$', '')"


@query(
    "answer_text",
    f"""WITH f AS (SELECT count(*) AS n, {sql.round2('sum(CAST(amount AS DECIMAL(18,2)))')} AS v
          FROM ({inputs.ITEMS}) i WHERE returned),
        c AS (SELECT category, {sql.round2('sum(CAST(amount AS DECIMAL(18,2)))')} AS s, count(*) AS n
          {_JOINED} WHERE lower(status) <> 'returned' AND quantity >= 10 GROUP BY category)
        SELECT 'scalar' AS answer_type, 'Based on dataset **items** (' || n
          || ' rows evaluated), the computed **sum_amount** is **$' || format('{{:,.2f}}', v) || '**.' AS summary FROM f
        UNION ALL
        SELECT 'table', 'In **items** across ' || (SELECT sum(n) FROM c) || ' records, **' || category
          || '** ranked highest with **' || {_PLAIN.format(x='s')}
          || '** in total_sales. Showing top ' || (SELECT count(*) FROM c) || ' records below.'
        FROM (SELECT * FROM c ORDER BY s DESC, category LIMIT 1) t
        UNION ALL
        SELECT 'empty_result', 'No records matched the query criteria in dataset **orders**.'
        UNION ALL
        SELECT 'scalar', 'Based on dataset **items** (' || n
          || ' rows evaluated), the computed **line_count** is **' || format('{{:,}}', n) || '**.' FROM f""",
)
def answer_text(spark, folder):
    loaded = _commerce(spark, folder)
    scalar = {**TOTALS_SPEC, "metrics": TOTALS_SPEC["metrics"][:1]}
    counted = {**TOTALS_SPEC, "metrics": TOTALS_SPEC["metrics"][2:]}
    empty = {
        "dataset": "orders",
        "filters": [{"field": "status", "op": "eq", "value": "no such status"}],
    }
    specs = (scalar, CATEGORY_SPEC, empty, counted)
    return reduce(DataFrame.unionByName, [declared_query.answer_text(loaded, s) for s in specs])


@query(
    "find_value",
    """SELECT 'name' AS "column", name AS value, count(*) AS rows FROM (
         SELECT p_name AS name FROM part) x WHERE contains(lower(name), 'an') GROUP BY name
       UNION ALL SELECT 'brand', p_brand, count(*) FROM part WHERE contains(lower(p_brand), 'an') GROUP BY p_brand
       UNION ALL SELECT 'category', p_type, count(*) FROM part WHERE contains(lower(p_type), 'an') GROUP BY p_type""",
)
def find_value(spark, folder):
    return filters.find_value(inputs.products(spark, folder).select("name", "brand", "category"), "an")


_EXPECTED = {
    "returned lines": ({**TOTALS_SPEC, "metrics": TOTALS_SPEC["metrics"][2:]}, "0"),
    "all lines": ({"dataset": "items", "metrics": [{"agg": "count", "field": "*", "alias": "n"}]}, None),
    "no such column": ({"dataset": "items", "metrics": [{"agg": "sum", "field": "nope"}]}, "1"),
}


@query(
    "expected_scalars",
    f"""SELECT 'returned lines' AS "case", 'ok' AS status, CAST(count(*) AS VARCHAR) AS scalar_value,
          CAST(count(*) AS VARCHAR) = '0' AS expected_match FROM ({inputs.ITEMS}) i WHERE returned
        UNION ALL SELECT 'all lines', 'ok', CAST(count(*) AS VARCHAR), true FROM lineitem
        UNION ALL SELECT 'no such column', 'error', NULL, false""",
)
def expected_scalars(spark, folder):
    """A batch of descriptions beside the scalars that somebody expects of them."""
    found = reports.scalar_results(_commerce(spark, folder), {c: s for c, (s, _) in _EXPECTED.items()})
    found = found.withColumn("status", F.split_part("status", F.lit(":"), F.lit(1)))
    expected = spark.createDataFrame(
        [(c, "ok", v) for c, (_, v) in _EXPECTED.items()], "case string, status string, scalar_value string"
    )
    return reports.match_expectations(found, expected, ["case"]).select("case", "status", "scalar_value", "expected_match")
