"""Joins, fan-out and referential integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.catalog import inputs
from shelfwise.catalog.inputs import table
from shelfwise.catalog.registry import query
from shelfwise.operators import joins


@query(
    "join_inner",
    """SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def join_inner(spark, folder):
    joined = joins.key_join(
        table(spark, folder, "orders"), table(spark, folder, "customer"), "o_custkey", "c_custkey"
    )
    return joined.select("o_orderkey", "o_custkey", "o_totalprice", "c_name", "c_mktsegment")


@query(
    "join_left",
    """SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN
         (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey""",
)
def join_left(spark, folder):
    large = table(spark, folder, "orders").where("o_totalprice > 200000")
    joined = joins.key_join(
        table(spark, folder, "customer"), large, "c_custkey", "o_custkey", "left"
    )
    return joined.select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


_HALVES = (
    "(SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0)",
    "(SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 200000)",
)


def _halves(spark, folder):
    rich = table(spark, folder, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    large = table(spark, folder, "orders").where("o_totalprice > 200000")
    return rich, large.select("o_custkey", "o_orderkey")


@query(
    "join_right",
    f"SELECT * FROM {_HALVES[0]} a RIGHT JOIN {_HALVES[1]} b ON c_custkey = o_custkey",
)
def join_right(spark, folder):
    return joins.key_join(*_halves(spark, folder), "c_custkey", "o_custkey", "right")


@query(
    "join_full",
    f"SELECT * FROM {_HALVES[0]} a FULL JOIN {_HALVES[1]} b ON c_custkey = o_custkey",
)
def join_full(spark, folder):
    return joins.key_join(*_halves(spark, folder), "c_custkey", "o_custkey", "outer")


@query(
    "join_collision",
    f"""WITH o AS ({inputs.ORDERS}), t AS (SELECT customer_id, count(*) AS order_count,
          CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_amount
          FROM o GROUP BY customer_id)
        SELECT o.customer_id, order_id, o.total_amount, order_count,
               t.total_amount AS total_amount_totals
        FROM o JOIN t ON o.customer_id = t.customer_id""",
)
def join_collision(spark, folder):
    left = inputs.orders(spark, folder).select("order_id", "customer_id", "total_amount")
    totals = left.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum(F.col("total_amount").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total_amount"),
    )
    return joins.key_join(left, totals, "customer_id", "customer_id", right_name="totals")


@query(
    "join_null_safe",
    f"""WITH p AS ({inputs.DIRTY_PART}), b AS (SELECT brand, count(*) AS brand_count FROM p GROUP BY brand)
        SELECT product_id, p.brand, brand_count FROM p JOIN b ON p.brand IS NOT DISTINCT FROM b.brand""",
)
def join_null_safe(spark, folder):
    left = inputs.dirty_part(spark, folder).select("product_id", "brand")
    counts = left.groupBy("brand").agg(F.count(F.lit(1)).alias("brand_count"))
    return joins.key_join(left, counts, "brand", "brand", null_safe=True)


def _fanout_sql(joined: str, base: str) -> str:
    ratio = f"CAST(round(CAST(CAST(({joined}) AS DOUBLE) / {base} AS DECIMAL(38,6)), 2) AS DOUBLE)"
    return f"""CAST(({joined}) AS DECIMAL(38,0)) AS rows_joined, {ratio} AS fanout_ratio,
               {ratio} > 3.0 AS fanout_warning"""


@query(
    "join_fanout",
    f"""SELECT (SELECT count(*) FROM orders) AS rows_left, (SELECT count(*) FROM lineitem) AS rows_right,
        {_fanout_sql('SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey',
                     '(SELECT count(*) FROM orders)')}""",
)
def join_fanout(spark, folder):
    return joins.join_diagnostics(
        table(spark, folder, "orders"), table(spark, folder, "lineitem"), "o_orderkey", "l_orderkey"
    )


@query(
    "join_fanout_outer",
    f"""SELECT (SELECT count(*) FROM {_HALVES[0]} a) AS rows_left,
          (SELECT count(*) FROM {_HALVES[1]} b) AS rows_right,
        {_fanout_sql(f'SELECT count(*) FROM {_HALVES[0]} a FULL JOIN {_HALVES[1]} b ON c_custkey = o_custkey',
                     f'greatest((SELECT count(*) FROM {_HALVES[0]} a), (SELECT count(*) FROM {_HALVES[1]} b))')}""",
)
def join_fanout_outer(spark, folder):
    return joins.join_diagnostics(*_halves(spark, folder), "c_custkey", "o_custkey", "outer")


@query(
    "join_chain",
    """SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS revenue,
              count(*) AS line_count
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def join_chain(spark, folder):
    joined = table(spark, folder, "lineitem")
    for name, left_on, right_on in (
        ("orders", "l_orderkey", "o_orderkey"),
        ("customer", "o_custkey", "c_custkey"),
        ("nation", "c_nationkey", "n_nationkey"),
    ):
        joined = joins.key_join(joined, table(spark, folder, name), left_on, right_on, right_name=name)
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return joined.groupBy("n_name").agg(
        F.sum(price).cast("decimal(38,2)").alias("revenue"), F.count(F.lit(1)).alias("line_count")
    )


_PARENTS = "(SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0)"


def _parents(spark, folder):
    return table(spark, folder, "part").where("p_partkey % 10 <> 0")


@query(
    "ref_integrity",
    f"""WITH o AS (SELECT * FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM {_PARENTS} x))
        SELECT (SELECT count(*) FROM {_PARENTS} x) AS parent_distinct_keys,
               (SELECT count(DISTINCT l_partkey) FROM lineitem) AS child_distinct_keys,
               (SELECT count(DISTINCT l_partkey) FROM o) AS orphaned_keys_count,
               (SELECT count(*) FROM o) AS orphaned_child_rows,
               (SELECT array_to_string(list_sort(list(CAST(k AS VARCHAR))), ',')
                FROM (SELECT DISTINCT l_partkey AS k FROM o ORDER BY k LIMIT 5) s)
                 AS sample_orphaned_keys""",
)
def ref_integrity(spark, folder):
    found = joins.referential_integrity(
        _parents(spark, folder), "p_partkey", table(spark, folder, "lineitem"), "l_partkey"
    )
    return found.withColumn("sample_orphaned_keys", F.array_join("sample_orphaned_keys", ","))


@query(
    "orphan_rows",
    f"""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
        WHERE l_partkey NOT IN (SELECT p_partkey FROM {_PARENTS} x)""",
)
def orphan_rows(spark, folder):
    found = joins.orphan_rows(
        table(spark, folder, "lineitem"), "l_partkey", _parents(spark, folder), "p_partkey"
    )
    return found.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "matched_rows",
    f"""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
        WHERE l_partkey IN (SELECT p_partkey FROM {_PARENTS} x)""",
)
def matched_rows(spark, folder):
    found = joins.matched_rows(
        table(spark, folder, "lineitem"), "l_partkey", _parents(spark, folder), "p_partkey"
    )
    return found.select("l_orderkey", "l_linenumber", "l_partkey")


PAIRS = (
    ("customers", "customer", "c_custkey", "orders", "orders", "o_custkey", "1:N"),
    ("orders", "orders", "o_orderkey", "order_items", "lineitem", "l_orderkey", "1:N"),
    ("products", "part", "p_partkey", "order_items", "lineitem", "l_partkey", "1:N"),
    ("stores", "supplier", "s_suppkey", "order_items", "lineitem", "l_suppkey", "1:N"),
)


def _pair_sql(parent, ptable, pkey, child, ctable, ckey, expected):
    return f"""SELECT '{parent}' AS parent, '{child}' AS child, '{pkey}' AS parent_key,
        '{ckey}' AS child_key, '{expected}' AS expected,
        CASE WHEN (SELECT max(n) FROM (SELECT count(*) AS n FROM {ptable} GROUP BY {pkey}) a) > 1
             THEN 'M' ELSE '1' END || ':' ||
        CASE WHEN (SELECT max(n) FROM (SELECT count(*) AS n FROM {ctable} GROUP BY {ckey}) b) > 1
             THEN 'N' ELSE '1' END AS observed,
        (SELECT count(DISTINCT {pkey}) FROM {ptable}) AS parent_keys,
        (SELECT count(DISTINCT {ckey}) FROM {ctable}) AS child_keys,
        (SELECT count(DISTINCT {ckey}) FROM {ctable} WHERE {ckey} NOT IN (SELECT {pkey} FROM {ptable}))
          AS orphaned_keys,
        (SELECT count(*) FROM {ctable} WHERE {ckey} NOT IN (SELECT {pkey} FROM {ptable})) AS orphaned_rows,
        CAST((SELECT count(*) FROM {ptable} JOIN {ctable} ON {pkey} = {ckey}) AS DECIMAL(38,0))
          AS rows_joined"""


@query("relationship_report", " UNION ALL ".join(_pair_sql(*p) for p in PAIRS))
def relationship_report(spark, folder):
    loaded = {p[0]: table(spark, folder, p[1]) for p in PAIRS}
    loaded |= {p[3]: table(spark, folder, p[4]) for p in PAIRS}
    known = [joins.Relationship(p[0], p[3], p[2], p[5], p[6]) for p in PAIRS]
    return joins.relationship_report(loaded, known)


