"""Sales, inventory and category figures with formula and citation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numbers import money_of, number_of
from shelfwise.functions.text import name_col
from shelfwise.roles import require_role, resolve_role

# Order states that count as returned.
RETURNED = ("returned", "refunded", "cancelled")

# Money sums need more digits than any single amount.
MONEY_SUM = "decimal(38,2)"


def money_sum(amount: Column) -> Column:
    return F.coalesce(F.round(F.sum(amount), 2), F.lit(0)).cast(MONEY_SUM)


def ratio2(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """numerator / denominator * scale at two decimals, 0 without a denominator."""
    share = F.try_divide(numerator.cast("double"), denominator.cast("double")) * scale
    return F.coalesce(F.round(share.cast("decimal(28,6)"), 2), F.lit(0)).cast("decimal(18,2)")


def sales_metrics(
    orders: DataFrame,
    columns: Mapping[str, str] | None = None,
    returned: Sequence[str] = RETURNED,
) -> DataFrame:
    """One row of order figures from one scan.

    ``columns`` may name the revenue and status columns. Amounts that do not
    parse count as 0 and are reported as ``unparsed_rows``.
    """
    revenue = require_role(orders.columns, "revenue", columns)
    status = resolve_role(orders.columns, "status", columns)
    amount = money_of(orders, revenue)
    back = (
        F.lower(name_col(status).cast("string")).isin(*returned) if status else F.lit(False)
    )
    sums = orders.select(amount.alias("a"), F.coalesce(back, F.lit(False)).alias("b")).agg(
        F.count(F.lit(1)).alias("total_orders"),
        money_sum(F.col("a")).alias("gross_revenue"),
        F.count_if("b").alias("returned_orders"),
        money_sum(F.when(F.col("b"), F.col("a"))).alias("returned_revenue"),
        F.count_if(F.col("a").isNull()).alias("unparsed_rows"),
    )
    return sums.select(
        "total_orders",
        "gross_revenue",
        (F.col("gross_revenue") - F.col("returned_revenue")).cast(MONEY_SUM).alias("net_revenue"),
        ratio2(F.col("gross_revenue"), F.col("total_orders")).alias("aov"),
        ratio2(F.col("returned_orders"), F.col("total_orders"), 100.0).alias("return_rate_pct"),
        "returned_orders",
        "returned_revenue",
        "unparsed_rows",
    )


def sales_metrics_long(orders: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """(metric, value, formula, citation), one row per figure."""
    revenue = require_role(orders.columns, "revenue", columns)
    figures = sales_metrics(orders, columns)

    def row(name, formula, citation):
        return F.struct(
            F.lit(name).alias("metric"),
            F.col(name).cast(MONEY_SUM).alias("value"),
            F.lit(formula).alias("formula"),
            citation.alias("citation"),
        )

    def text(pattern, *names):
        return F.format_string(pattern, *[F.col(n).cast("string") for n in names])

    # Formulas and citations.
    rows = [
        row("total_orders", "COUNT(order_id)", text("Counted %s order rows", "total_orders")),
        row("gross_revenue", f"SUM({revenue})", F.lit(f"Summed {revenue} across all orders")),
        row("net_revenue", "gross_revenue - returned_revenue",
            text("$%s - $%s", "gross_revenue", "returned_revenue")),
        row("aov", "gross_revenue / total_orders",
            text("$%s / %s orders = $%s", "gross_revenue", "total_orders", "aov")),
        row("return_rate_pct", "(returned_orders / total_orders) * 100",
            text("(%s returned / %s total) * 100 = %s%%",
                 "returned_orders", "total_orders", "return_rate_pct")),
    ]
    return figures.select(F.inline(F.array(*rows)))


def _stock_totals(inventory: DataFrame, columns: Mapping[str, str] | None) -> DataFrame:
    stock = require_role(inventory.columns, "stock", columns)
    level = F.coalesce(number_of(inventory, stock), F.lit(0.0)).cast("decimal(28,4)")
    return inventory.select(level.alias("s")).agg(
        F.coalesce(F.sum("s"), F.lit(0)).cast("decimal(38,0)").alias("total_stock"),
        F.count(F.lit(1)).alias("total_skus"),
        F.count_if(F.col("s") <= 0).alias("stockout_skus"),
    )


def inventory_metrics(
    inventory: DataFrame, columns: Mapping[str, str] | None = None
) -> DataFrame:
    """One row: stock, SKU rows, rows without stock and their share."""
    return _stock_totals(inventory, columns).select(
        F.col("total_stock").cast("bigint").alias("total_stock"),
        "total_skus",
        "stockout_skus",
        ratio2(F.col("stockout_skus"), F.col("total_skus"), 100.0).alias("stockout_frequency_pct"),
    )


def sell_through(
    inventory: DataFrame,
    sales: DataFrame,
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row: units sold, stock, and sold / (sold + stock) in percent.

    Both tables are summed on their own; the two rows meet in one aggregate.
    """
    units = require_role(sales.columns, "units", columns)
    sold = sales.agg(
        F.coalesce(F.sum(number_of(sales, units).cast("decimal(28,4)")), F.lit(0))
        .cast("decimal(38,0)")
        .alias("units_sold")
    )
    stock = _stock_totals(inventory, columns).select("total_stock")
    both = sold.unionByName(stock, allowMissingColumns=True).agg(
        F.max("units_sold").cast("bigint").alias("units_sold"),
        F.max("total_stock").cast("bigint").alias("total_stock"),
    )
    return both.select(
        "units_sold",
        "total_stock",
        ratio2(
            F.col("units_sold"), F.col("units_sold") + F.col("total_stock"), 100.0
        ).alias("sell_through_rate_pct"),
    )


def _categories(sums: DataFrame, ordered: bool) -> DataFrame:
    found = sums.select(
        "category", "revenue", "order_count",
        ratio2(F.col("revenue"), F.col("order_count")).alias("aov"),
    )
    return found.orderBy(F.desc("revenue"), F.asc("category")) if ordered else found


def category_metrics(
    df: DataFrame, columns: Mapping[str, str] | None = None, ordered: bool = False
) -> DataFrame:
    """Revenue, order rows and average per category; highest revenue first if ``ordered``."""
    category = require_role(df.columns, "category", columns)
    revenue = require_role(df.columns, "category_revenue", columns)
    key = name_col(category)
    sums = (
        df.where(key.isNotNull())
        .groupBy(key.cast("string").alias("category"))
        .agg(
            money_sum(money_of(df, revenue)).alias("revenue"),
            F.count(F.lit(1)).alias("order_count"),
        )
    )
    return _categories(sums, ordered)


def category_metrics_of(
    items: DataFrame,
    products: DataFrame,
    key: str = "product_id",
    columns: Mapping[str, str] | None = None,
    ordered: bool = False,
) -> DataFrame:
    """The same for lines that name a product whose category stands in another table.

    Lines are summed per product before the join, so that it takes a row per
    product, and a product of very many lines is no hot key in it. Lines of an
    unknown product or category are left out; a product that ``products`` lists
    more than once counts once for each.
    """
    category = require_role(products.columns, "category", columns)
    revenue = require_role(items.columns, "category_revenue", columns)
    lines = items.groupBy(name_col(key).alias("__key")).agg(
        F.sum(money_of(items, revenue)).cast("decimal(38,6)").alias("amount"), F.count(F.lit(1)).alias("lines")
    )
    named = products.select(name_col(key).alias("__key"), name_col(category).cast("string").alias("category"))
    sums = (
        lines.join(named.where("category IS NOT NULL"), "__key").groupBy("category")
        .agg(money_sum(F.col("amount")).alias("revenue"), F.sum("lines").alias("order_count"))
    )
    return _categories(sums, ordered)


def costed_items(
    items: DataFrame, products: DataFrame, key: str = "product_id", revenue: str = "revenue", units: str = "units"
) -> DataFrame:
    """(revenue, cost_of_goods), a row per product, for ``margin_metrics``: lines are summed before they meet the cost."""
    sums = items.groupBy(name_col(key).alias("__key")).agg(
        F.sum(money_of(items, revenue)).cast("decimal(30,6)").alias("revenue"),
        F.sum(number_of(items, units).cast("decimal(18,4)")).cast("decimal(24,4)").alias("units"),
    )
    costs = products.select(name_col(key).alias("__key"), name_col("cost").cast("decimal(14,4)").alias("cost"))
    goods = (F.col("units") * F.col("cost")).cast("decimal(30,6)")
    return sums.join(costs, "__key").select("revenue", goods.alias("cost_of_goods"))


def margin_metrics(
    items: DataFrame, inventory: DataFrame, days: int = 365
) -> DataFrame:
    """Extension: gross margin, GMROI and days of inventory.

    ``items`` needs revenue and cost_of_goods, ``inventory`` needs stock and
    cost. gmroi = margin / inventory at cost; dio = inventory at cost / cost
    of goods * days.
    """
    sold = items.agg(
        money_sum(money_of(items, "revenue")).alias("revenue"),
        money_sum(money_of(items, "cost_of_goods")).alias("cost_of_goods"),
    )
    held = inventory.agg(
        money_sum(
            number_of(inventory, "stock").cast("decimal(18,4)") * money_of(inventory, "cost")
        ).alias("inventory_at_cost")
    )
    both = sold.unionByName(held, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("revenue", "cost_of_goods", "inventory_at_cost")]
    )
    margin = F.col("revenue") - F.col("cost_of_goods")
    return both.select(
        "revenue",
        "cost_of_goods",
        "inventory_at_cost",
        margin.cast(MONEY_SUM).alias("gross_margin"),
        ratio2(margin, F.col("revenue"), 100.0).alias("gross_margin_pct"),
        ratio2(margin, F.col("inventory_at_cost")).alias("gmroi"),
        ratio2(F.col("inventory_at_cost"), F.col("cost_of_goods"), float(days)).alias("dio"),
    )
