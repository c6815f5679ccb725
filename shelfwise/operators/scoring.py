"""Product health and customer segments with the factors that explain them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numbers import is_numeric, money_of, number_of
from shelfwise.functions.text import name_col
from shelfwise.operators.metrics import money_sum
from shelfwise.roles import require_role

# Base score and, per signal, (test, points, text) in order.
BASE_SCORE = 50
MARGIN_BANDS = ((0.50, 20, "Strong"), (0.30, 10, "Healthy"), (0.15, 0, "Moderate"))
LOW_MARGIN = (-15, "Low")
RETURN_BANDS = ((0.03, 10, "Very low"), (0.08, 0, "Acceptable"), (0.15, -15, "Elevated"))
CRITICAL_RETURN = (-25, "Critical")
RECOMMENDATIONS = (
    (80, "Promote / Feature: High performer with solid fundamentals"),
    (60, "Maintain: Stable performer"),
    (40, "Review: Investigate low margins or return rate issues"),
)
LAST_RECOMMENDATION = "Intervene: High risk of loss, stockout, or customer dissatisfaction"
MISSING = {
    "margin": "Unit cost missing; margin contribution omitted",
    "unreadable": "Cost or price could not be parsed as numeric",
    "price": "Price not positive",
    "sales": "Sales transaction history not provided",
    "returns": "Return data not linked for this product",
    "stock": "Inventory level not provided",
}
FACTOR = "struct<factor:string,points:int,reason:string>"


def _bands(value: Column, bands, last, above: bool):
    """Points and label of the first band the value falls into."""
    points = label = None
    for limit, p, text in bands:
        test = value >= limit if above else value <= limit
        points = F.when(test, p) if points is None else points.when(test, p)
        label = F.when(test, text) if label is None else label.when(test, text)
    return points.otherwise(last[0]), label.otherwise(last[1])


def _percent(share: Column) -> Column:
    return F.format_string("%s%%", F.round((share * 100).cast("decimal(28,8)"), 1).cast("string"))


def _units(c: Column) -> Column:
    return c.cast("decimal(38,0)").cast("string")


def _factor(present: Column, name: str, points: Column, reason: Column) -> Column:
    return F.when(
        present,
        F.struct(F.lit(name).alias("factor"), points.alias("points"), reason.alias("reason")),
    ).cast(FACTOR)


def _typed_price(products: DataFrame, role: str, names: tuple[str, str]) -> tuple[Column, Column]:
    """(number, given): the first of two columns that holds something other than 0."""
    present = [n for n in names if n in products.columns]
    if not present:
        return F.lit(None).cast("double"), F.lit(False)
    values = []
    for n in present:
        number = number_of(products, n)
        raw = name_col(n)
        given = number != 0 if is_numeric(products.schema[n].dataType) else (
            raw.isNotNull() & (raw != "")
        )
        values.append((number, given))
    number = F.coalesce(*[F.when(g, n) for n, g in values])
    given = values[0][1]
    for _, g in values[1:]:
        given = F.coalesce(given, F.lit(False)) | F.coalesce(g, F.lit(False))
    return number, F.coalesce(given, F.lit(False))


def product_health(products: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Health score of 0 to 100 per product with factors and missing evidence.

    ``products`` has product_id and may have name, price and cost. ``signals``
    has one row per product_id with any of sales_units, return_rate and
    stock_qty; what is absent is listed as missing, never guessed.
    """
    price, has_price = _typed_price(products, "price", ("price", "unit_price"))
    cost, has_cost = _typed_price(products, "cost", ("cost", "unit_cost"))
    title = [name_col(c) for c in ("name", "title") if c in products.columns]
    # An empty name is no name.
    shown = F.coalesce(*[F.when(t != "", t) for t in title], F.lit("Unnamed Product"))
    df = products.select(
        "product_id",
        shown.alias("product_name"),
        price.alias("p"),
        cost.alias("c"),
        (has_price & has_cost).alias("priced"),
    )
    if signals is not None:
        df = df.join(signals, "product_id", "left")
    for name, kind in (("sales_units", "double"), ("return_rate", "double"), ("stock_qty", "double")):
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        df = df.withColumn(name, value)

    p, c = F.col("p"), F.col("c")
    readable = F.col("priced") & p.isNotNull() & c.isNotNull()
    margin = F.when(readable & (p > 0), (p - c) / p)
    units, rate, stock = F.col("sales_units"), F.col("return_rate"), F.col("stock_qty")

    m_points, m_label = _bands(margin, MARGIN_BANDS, LOW_MARGIN, above=True)
    r_points, r_label = _bands(rate, RETURN_BANDS, CRITICAL_RETURN, above=False)
    # Limits, points and texts of the factors.
    factors = [
        _factor(
            margin.isNotNull(), "Gross Margin", m_points,
            F.concat(m_label, F.lit(" gross margin ("), _percent(margin), F.lit(")")),
        ),
        _factor(
            units.isNotNull(), "Sales Velocity",
            F.when(units > 100, 20).when(units >= 25, 10).when(units > 0, 0).otherwise(-15),
            F.when(units > 100, F.format_string("High sales volume (%s units)", _units(units)))
            .when(units >= 25, F.format_string("Moderate sales volume (%s units)", _units(units)))
            .when(units > 0, F.format_string("Slow sales volume (%s units)", _units(units)))
            .otherwise("Zero sales recorded"),
        ),
        _factor(
            rate.isNotNull(), "Return Rate", r_points,
            F.concat(r_label, F.lit(" return rate ("), _percent(rate), F.lit(")")),
        ),
        _factor(
            stock.isNotNull(), "Stock Level",
            F.when(stock == 0, -20).when(stock < 10, -5).when(stock > 500, -5).otherwise(10),
            F.when(stock == 0, "Out of stock (lost sales risk)")
            .when(stock < 10, F.format_string("Critically low stock (%s units left)", _units(stock)))
            .when(stock > 500, F.format_string("Potential overstocking (%s units on hand)", _units(stock)))
            .otherwise(F.format_string("Optimal stock coverage (%s units on hand)", _units(stock))),
        ),
    ]
    notes = F.array_compact(
        F.array(
            F.when(~F.col("priced"), MISSING["margin"])
            .when(~readable, MISSING["unreadable"])
            .when(p <= 0, MISSING["price"]),
            F.when(units.isNull(), MISSING["sales"]),
            F.when(rate.isNull(), MISSING["returns"]),
            F.when(stock.isNull(), MISSING["stock"]),
        )
    )
    listed = df.select(
        "product_id",
        "product_name",
        F.array_compact(F.array(*factors)).alias("contributing_factors"),
        notes.alias("missing_evidence"),
    )
    summed = F.aggregate("contributing_factors", F.lit(BASE_SCORE), lambda s, f: s + f["points"])
    scored = listed.withColumn("health_score", F.greatest(F.lit(0), F.least(F.lit(100), summed)))
    advice = None
    for limit, text in RECOMMENDATIONS:
        test = F.col("health_score") >= limit
        advice = F.when(test, text) if advice is None else advice.when(test, text)
    return scored.select(
        "product_id",
        "product_name",
        "health_score",
        advice.otherwise(LAST_RECOMMENDATION).alias("recommendation"),
        "contributing_factors",
        "missing_evidence",
    )


def product_signals(items: DataFrame, inventory: DataFrame) -> DataFrame:
    """(product_id, sales_units, return_rate, stock_qty).

    ``items`` has product_id, quantity and returned; ``inventory`` has
    product_id and stock. Each is reduced to one row per product before the
    two meet, so a product with very many lines costs one row in the join.
    """
    sold = items.groupBy("product_id").agg(
        F.sum(number_of(items, "quantity").cast("decimal(18,4)")).cast("double").alias("sales_units"),
        (F.count_if("returned").cast("double") / F.count(F.lit(1))).alias("return_rate"),
    )
    held = inventory.groupBy("product_id").agg(
        F.sum(number_of(inventory, "stock").cast("decimal(18,4)")).cast("double").alias("stock_qty")
    )
    return sold.join(held, "product_id", "full")


def health_factors(scored: DataFrame) -> DataFrame:
    """(product_id, factor, points, reason), one row per factor."""
    return scored.select("product_id", F.inline("contributing_factors"))


def customer_segments(
    orders: DataFrame, columns: Mapping[str, str] | None = None, recency: bool = False, ordered: bool = False
) -> DataFrame:
    """Order count, spend and segment per customer; highest spend first if ``ordered``.

    ``recency`` adds, as an extension, the days between a customer's last
    order and the last order of the table.
    """
    customer = require_role(orders.columns, "customer", columns)
    revenue = require_role(orders.columns, "customer_revenue", columns)
    key = name_col(customer)
    sums = [
        F.count(F.lit(1)).alias("frequency_orders"),
        money_sum(money_of(orders, revenue)).alias("monetary_spend"),
    ]
    if recency:
        date = require_role(orders.columns, "date", columns)
        sums.append(F.max(name_col(date).try_cast("date")).alias("last_order"))
    grouped = (
        orders.where(key.isNotNull()).groupBy(key.cast("string").alias("customer_id")).agg(*sums)
    )
    n, spend = F.col("frequency_orders"), F.col("monetary_spend")
    # Segment names and limits.
    segment = (
        F.when((n >= 5) & (spend >= 500), "Champion")
        .when((n >= 3) | (spend >= 250), "Loyal Customer")
        .when((n == 1) & (spend < 100), "Occasional / Low Value")
        .otherwise("Regular Customer")
    )
    evidence = F.format_string(
        "Calculated from %d orders totaling $%s", n, spend.cast("string")
    )
    result = grouped.withColumns({"segment": segment, "audit_evidence": evidence})
    if recency:
        last = result.agg(F.max("last_order")).scalar()
        result = result.withColumn("recency_days", F.datediff(last, "last_order")).drop("last_order")
    return result.orderBy(F.desc("monetary_spend"), F.asc("customer_id")) if ordered else result
