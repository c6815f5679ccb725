"""Sessions of declared queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.catalog.inputs import table
from shelfwise.catalog.registry import query
from shelfwise.plans.session_run import session_results

_STATUS = {"field": "o_orderstatus", "op": "eq", "value": "F"}
_LARGE = {"field": "o_totalprice", "op": "gt", "value": 200_000}


def _turn(agg, field, *filters, follow_up=False, dataset="orders"):
    return {
        "follow_up": follow_up,
        "spec": {"dataset": dataset, "filters": list(filters), "metrics": [{"agg": agg, "field": field, "alias": "x"}]},
    }


# The second turn narrows the first, the third looks at all orders and leaves what is held, which the
# fourth takes up again; the fifth finds nothing and the last names a table that is not there.
_TURNS = [
    _turn("count", "*", _STATUS),
    _turn("count_distinct", "o_custkey", _LARGE, follow_up=True),
    _turn("count", "*"),
    _turn("sum", "o_totalprice", follow_up=True),
    _turn("count", "*", {"field": "o_orderstatus", "op": "eq", "value": "none such"}),
    _turn("count", "*", dataset="returns"),
]
_DECIMAL = "regexp_replace(CAST(CAST({c} AS DECIMAL(38,2)) AS VARCHAR), '0$', '')"


@query(
    "session_queries",
    f"""WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), g AS (SELECT * FROM f WHERE o_totalprice > 200000),
        a AS (SELECT 1 AS turn, 'o_orderstatus eq F' AS filters, count(*) AS rows_considered, count(*)::VARCHAR AS scalar_value FROM f
          UNION ALL SELECT 2, 'o_orderstatus eq F;o_totalprice gt 200000', count(*), count(DISTINCT o_custkey)::VARCHAR FROM g
          UNION ALL SELECT 3, '', count(*), count(*)::VARCHAR FROM orders
          UNION ALL SELECT 4, 'o_orderstatus eq F;o_totalprice gt 200000', count(*),
            {_DECIMAL.format(c='sum(CAST(o_totalprice AS DECIMAL(18,2)))')} FROM g
          UNION ALL SELECT 5, 'o_orderstatus eq none such', count(*), count(*)::VARCHAR FROM orders WHERE o_orderstatus = 'none such'
          UNION ALL SELECT 6, NULL, NULL, NULL)
        SELECT turn, CASE WHEN turn = 6 THEN 'error' WHEN rows_considered = 0 THEN 'empty' ELSE 'ok' END AS status,
          CASE WHEN turn < 6 THEN 'scalar' END AS answer_type, filters, rows_considered, scalar_value,
          CASE WHEN turn < 6 THEN 'LOAD orders (' || (SELECT count(*) FROM orders) || ' rows)' END AS first_step FROM a""",
)
def session_queries(spark, folder):
    found = session_results({"orders": table(spark, folder, "orders")}, _TURNS)
    return found.select(
        "turn", "status", "answer_type", F.array_join("filters", ";").alias("filters"), "rows_considered", "scalar_value",
        F.get("operations", F.lit(0)).alias("first_step"),
    )
