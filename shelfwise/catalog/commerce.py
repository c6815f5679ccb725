"""Sales and inventory figures, normalization, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.catalog import inputs, sql
from shelfwise.catalog.inputs import table
from shelfwise.catalog.registry import query
from shelfwise.functions.similarity import levenshtein_similarity, similarity
from shelfwise.functions.text import normalize_sku
from shelfwise.operators import metrics, normalization, scoring
from shelfwise.plans.cleaning_run import plan_and_apply

ORDERS_CTE = f"d AS ({inputs.DIRTY_ORDERS})"
BACK = "lower({s}) IN ('returned', 'refunded', 'cancelled')"


def _sales_sql(source: str, amount: str, status: str) -> str:
    gross = f"coalesce(CAST(round(sum({amount}), 2) AS DECIMAL(38,2)), 0)"
    back = BACK.format(s=status)
    returned = f"coalesce(CAST(round(sum(CASE WHEN {back} THEN {amount} END), 2) AS DECIMAL(38,2)), 0)"
    count_back = f"count(*) FILTER ({back})"
    return f"""SELECT count(*) AS total_orders, CAST({gross} AS DECIMAL(38,2)) AS gross_revenue,
        CAST({gross} - {returned} AS DECIMAL(38,2)) AS net_revenue,
        {sql.ratio2(gross, 'count(*)')} AS aov,
        {sql.ratio2(count_back, 'count(*)', '100')} AS return_rate_pct,
        {count_back} AS returned_orders, CAST({returned} AS DECIMAL(38,2)) AS returned_revenue,
        count(*) - count({amount}) AS unparsed_rows FROM {source}"""


MONEY = "CAST({c} AS DECIMAL(18,4))"
SALES = _sales_sql(f"({inputs.ORDERS}) o", MONEY.format(c="total_amount"), "status")


@query("kpi_sales", SALES)
def kpi_sales(spark, folder):
    return metrics.sales_metrics(inputs.orders(spark, folder))


@query(
    "kpi_sales_cleaned",
    f"""WITH {ORDERS_CTE}, c AS (SELECT DISTINCT order_id, {sql.number('amount_text')} AS a,
          trim(status) AS status FROM d) {_sales_sql('c', 'a', 'status')}""",
)
def kpi_sales_cleaned(spark, folder):
    clean, _, _ = plan_and_apply(inputs.dirty_orders(spark, folder), "orders")
    return metrics.sales_metrics(clean, {"revenue": "amount_text"})


@query(
    "kpi_sales_long",
    f"""WITH k AS ({SALES})
        SELECT 'total_orders' AS metric, CAST(total_orders AS DECIMAL(38,2)) AS value,
               'COUNT(order_id)' AS formula, 'Counted ' || total_orders || ' order rows' AS citation FROM k
        UNION ALL SELECT 'gross_revenue', gross_revenue, 'SUM(total_amount)',
               'Summed total_amount across all orders' FROM k
        UNION ALL SELECT 'net_revenue', net_revenue, 'gross_revenue - returned_revenue',
               '$' || gross_revenue || ' - $' || returned_revenue FROM k
        UNION ALL SELECT 'aov', aov, 'gross_revenue / total_orders',
               '$' || gross_revenue || ' / ' || total_orders || ' orders = $' || aov FROM k
        UNION ALL SELECT 'return_rate_pct', return_rate_pct, '(returned_orders / total_orders) * 100',
               '(' || returned_orders || ' returned / ' || total_orders || ' total) * 100 = '
               || return_rate_pct || '%' FROM k""",
)
def kpi_sales_long(spark, folder):
    return metrics.sales_metrics_long(inputs.orders(spark, folder))


@query(
    "kpi_inventory",
    f"""SELECT CAST(sum(stock) AS BIGINT) AS total_stock, count(*) AS total_skus,
          count(*) FILTER (stock <= 0) AS stockout_skus,
          {sql.ratio2('count(*) FILTER (stock <= 0)', 'count(*)', '100')} AS stockout_frequency_pct
        FROM ({inputs.INVENTORY}) i""",
)
def kpi_inventory(spark, folder):
    return metrics.inventory_metrics(inputs.inventory(spark, folder))


@query(
    "kpi_sell_through",
    f"""WITH s AS (SELECT CAST(sum(CAST(l_quantity AS DECIMAL(28,4))) AS BIGINT) AS u FROM lineitem),
        i AS (SELECT CAST(sum(stock) AS BIGINT) AS t FROM ({inputs.INVENTORY}) x)
        SELECT u AS units_sold, t AS total_stock, {sql.ratio2('u', 'u + t', '100')}
          AS sell_through_rate_pct FROM s, i""",
)
def kpi_sell_through(spark, folder):
    return metrics.sell_through(inputs.inventory(spark, folder), inputs.items(spark, folder))


@query(
    "kpi_by_category",
    f"""WITH g AS (SELECT p_type AS category,
            CAST(round(sum({MONEY.format(c='l_extendedprice')}), 2) AS DECIMAL(38,2)) AS revenue,
            count(*) AS order_count
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type)
        SELECT category, revenue, order_count, {sql.ratio2('revenue', 'order_count')} AS aov FROM g""",
)
def kpi_by_category(spark, folder):
    items = inputs.items(spark, folder).select("product_id", F.col("amount").alias("sales"))
    products = inputs.products(spark, folder).select("product_id", "category")
    return metrics.category_metrics_of(items, products)


_SOLD = f"""SELECT {MONEY.format(c='l_extendedprice')} AS revenue,
    CAST(CAST(l_quantity AS DECIMAL(18,4)) * {MONEY.format(c='cost')} AS DECIMAL(18,4)) AS cost_of_goods
    FROM lineitem JOIN ({inputs.PRODUCTS}) p ON l_partkey = product_id"""
_HELD = f"""SELECT stock, {MONEY.format(c='cost')} AS cost FROM ({inputs.INVENTORY}) i
    JOIN ({inputs.PRODUCTS}) p ON i.product_id = p.product_id"""


@query(
    "kpi_margin",
    f"""WITH s AS (SELECT CAST(round(sum(revenue), 2) AS DECIMAL(38,2)) AS r,
            CAST(round(sum(cost_of_goods), 2) AS DECIMAL(38,2)) AS c FROM ({_SOLD}) x),
        h AS (SELECT CAST(round(sum(stock * cost), 2) AS DECIMAL(38,2)) AS v FROM ({_HELD}) y)
        SELECT r AS revenue, c AS cost_of_goods, v AS inventory_at_cost,
          CAST(r - c AS DECIMAL(38,2)) AS gross_margin, {sql.ratio2('(r - c)', 'r', '100')} AS gross_margin_pct,
          {sql.ratio2('(r - c)', 'v')} AS gmroi, {sql.ratio2('v', 'c', '365')} AS dio FROM s, h""",
)
def kpi_margin(spark, folder):
    products = inputs.products(spark, folder).select(
        "product_id", F.col("cost").cast("decimal(18,4)").alias("cost")
    )
    items = inputs.items(spark, folder).select("product_id", "quantity", "amount")
    sold = metrics.costed_items(items, products, revenue="amount", units="quantity")
    held = inputs.inventory(spark, folder).join(products, "product_id")
    return metrics.margin_metrics(sold, held)


_SKU_BARE = "regexp_replace(upper(trim({c})), '[\\s\\-_]', '', 'g')"


def _sku_sql(c: str) -> dict[str, str]:
    text, bare = f"upper(trim({c}))", _SKU_BARE.format(c=c)
    missing = f"{c} IS NULL OR trim({c}) = ''"
    odd = f"NOT regexp_matches({bare}, '^[\\p{{L}}\\p{{N}}]+$')"
    unusual = f"length({bare}) < 4 OR length({bare}) > 20"
    return {
        "value": f"CASE WHEN {missing} THEN NULL WHEN {odd} THEN {text} ELSE {bare} END",
        "confidence": f"CAST(CASE WHEN {missing} THEN 0.0 WHEN {odd} THEN 0.5 WHEN {unusual} THEN 0.7 "
        "ELSE 1.0 END AS DOUBLE)",
        "note": f"CASE WHEN {missing} THEN 'Missing SKU' "
        f"WHEN {odd} THEN 'Non-alphanumeric characters present' "
        f"WHEN {unusual} THEN 'Unusual SKU length (' || length({bare}) || ')' END",
    }


@query(
    "norm_sku",
    f"""WITH p AS ({inputs.DIRTY_PART}), s AS (SELECT sku AS raw FROM p UNION ALL SELECT name FROM p
          UNION ALL SELECT brand FROM p)
        SELECT raw, {', '.join(f'{e} AS {n}' for n, e in _sku_sql('raw').items())} FROM s""",
)
def norm_sku(spark, folder):
    df = inputs.dirty_part(spark, folder)
    raw = [df.select(F.col(c).alias("raw")) for c in ("sku", "name", "brand")]
    every = raw[0].unionByName(raw[1]).unionByName(raw[2])
    return every.withColumn("n", normalize_sku(F.col("raw"))).select("raw", "n.*")


BRANDS = {"brand#1": "Brand One", "brand#2": "Brand Two", "brand#13": "Brand Thirteen"}


def _map_sql(terms, text: str) -> str:
    cases = " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in terms.items())
    return f"CASE {text} {cases} END"


@query(
    "norm_brand_exact",
    f"""WITH p AS ({inputs.DIRTY_PART}), b AS (SELECT product_id, brand,
            {_map_sql(BRANDS, 'lower(trim(brand))')} AS hit FROM p)
        SELECT product_id, CASE WHEN brand IS NULL THEN 'Unknown' WHEN hit IS NOT NULL THEN hit
            ELSE {sql.initcap('trim(brand)')} END AS value,
          CAST(CASE WHEN brand IS NULL THEN 0.0 WHEN hit IS NOT NULL THEN 1.0 ELSE 0.75 END AS DOUBLE)
            AS confidence,
          CASE WHEN brand IS NULL THEN 'Missing brand' WHEN hit IS NOT NULL THEN NULL
            ELSE 'Brand not in canonical taxonomy' END AS note FROM b""",
)
def norm_brand_exact(spark, folder):
    df = inputs.dirty_part(spark, folder)
    found = normalization.normalize_brand(F.col("brand"), BRANDS, fuzzy=False)
    return df.select("product_id", found.alias("n")).select("product_id", "n.*")


@query("norm_brand")
def norm_brand(spark, folder):
    df = inputs.dirty_part(spark, folder)
    found = normalization.normalize_brand(F.col("brand"), BRANDS)
    return df.select("product_id", found.alias("n")).select("product_id", "n.*")


TERMS = {
    "red": "Red goods",
    "hot": "Hot goods",
    "small": "Small goods",
    "ring": "Rings",
    "bolt": "Bolts",
    "gear": "Gears",
    "hot ring": "Hot rings",
}


def _category_sql(match: str) -> str:
    order = list(TERMS)
    if match == "longest":
        order.sort(key=lambda t: -len(t))
        test = "regexp_matches(t, '(^|[^a-z0-9-]){w}($|[^a-z0-9-])')"
    else:
        test = "contains(t, '{w}')"
    term = "CASE " + " ".join(f"WHEN {test.format(w=w)} THEN '{w}'" for w in order) + " END"
    return f"""WITH n AS (SELECT p_partkey AS product_id, p_name AS raw FROM part
            UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL
              WHEN p_partkey % 7 = 0 THEN 'Bolt' ELSE p_type END FROM part),
        x AS (SELECT *, lower(trim(raw)) AS t FROM n),
        h AS (SELECT *, {_map_sql(TERMS, 't')} AS exact, {term} AS term FROM x)
        SELECT product_id, CASE WHEN raw IS NULL THEN 'Uncategorized' WHEN exact IS NOT NULL THEN exact
            WHEN term IS NOT NULL THEN {_map_sql(TERMS, 'term')} ELSE {sql.initcap('trim(raw)')} END AS value,
          CAST(CASE WHEN raw IS NULL THEN 0.0 WHEN exact IS NOT NULL THEN 1.0 WHEN term IS NOT NULL
            THEN 0.9 ELSE 0.6 END AS DOUBLE) AS confidence,
          CASE WHEN raw IS NULL THEN 'Missing category' WHEN exact IS NOT NULL THEN NULL
            WHEN term IS NOT NULL THEN 'Substring matched ''' || term || ''''
            ELSE 'Low confidence match; original preserved' END AS note FROM h"""


def _named_parts(spark, folder):
    part = table(spark, folder, "part")
    names = part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("raw"))
    types = part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 9 == 0, F.lit(None))
        .when(F.col("p_partkey") % 7 == 0, "Bolt")
        .otherwise(F.col("p_type"))
        .alias("raw"),
    )
    return names.unionByName(types)


def _categorized(spark, folder, **options):
    found = normalization.normalize_category(F.col("raw"), TERMS, **options)
    return _named_parts(spark, folder).select("product_id", found.alias("n")).select("product_id", "n.*")


@query("norm_category", _category_sql("first"))
def norm_category(spark, folder):
    return _categorized(spark, folder, match="first", fuzzy=False)


@query("norm_category_longest", _category_sql("longest"))
def norm_category_longest(spark, folder):
    return _categorized(spark, folder, match="longest", fuzzy=False)


@query("norm_category_fuzzy")
def norm_category_fuzzy(spark, folder):
    return _categorized(spark, folder, match="first", fuzzy=True)


CATEGORY_TERMS = {"standard": "Standard", "economy": "Economy", "large": "Large", "promo": "Promo"}
_ENRICHED = f"""p AS ({inputs.DIRTY_PART}),
    h AS (SELECT *, {_map_sql(CATEGORY_TERMS, 'lower(trim(category))')} AS exact,
        CASE {' '.join(f"WHEN contains(lower(category), '{t}') THEN '{t}'" for t in CATEGORY_TERMS)} END
          AS term, {_map_sql(BRANDS, 'lower(trim(brand))')} AS hit FROM p),
    e AS (SELECT product_id,
        CASE WHEN exact IS NOT NULL THEN exact WHEN term IS NOT NULL THEN {_map_sql(CATEGORY_TERMS, 'term')}
          ELSE {sql.initcap('trim(category)')} END AS category_normalized,
        CAST(CASE WHEN exact IS NOT NULL THEN 1.0 WHEN term IS NOT NULL THEN 0.9 ELSE 0.6 END AS DOUBLE)
          AS category_confidence,
        CASE WHEN brand IS NULL THEN 'Unknown' WHEN hit IS NOT NULL THEN hit
          ELSE {sql.initcap('trim(brand)')} END AS brand_normalized,
        CAST(CASE WHEN brand IS NULL THEN 0.0 WHEN hit IS NOT NULL THEN 1.0 ELSE 0.75 END AS DOUBLE)
          AS brand_confidence,
        {_sku_sql('sku')['value']} AS sku_clean FROM h)"""


def _enriched(spark, folder):
    return normalization.enrich_products(
        inputs.dirty_part(spark, folder),
        category_terms=CATEGORY_TERMS,
        brand_terms=BRANDS,
        match="first",
        fuzzy=False,
    )


@query("enrich_products", f"WITH {_ENRICHED} SELECT * FROM e")
def enrich_products(spark, folder):
    return _enriched(spark, folder).select(
        "product_id",
        "category_normalized",
        "category_confidence",
        "brand_normalized",
        "brand_confidence",
        "sku_clean",
    )


@query(
    "enrich_stats",
    f"""WITH {_ENRICHED} SELECT count(*) AS total_rows,
          count(*) FILTER (category_confidence >= 0.85) AS normalized_categories,
          count(*) FILTER (category_confidence < 0.85) AS uncertain_items FROM e""",
)
def enrich_stats(spark, folder):
    return normalization.enrichment_stats(_enriched(spark, folder))


@query("enrich_products_fuzzy")
def enrich_products_fuzzy(spark, folder):
    return normalization.enrich_products(inputs.dirty_part(spark, folder))


def _name_pairs(spark, folder):
    """Part names beside the category and type text of the same part."""
    df = inputs.dirty_part(spark, folder)
    return df.select(F.lower("name").alias("a"), F.lower("category").alias("b")).distinct()


@query("similarity_pairs")
def similarity_pairs(spark, folder):
    return _name_pairs(spark, folder).withColumn("ratio", similarity(F.col("a"), F.col("b")))


@query(
    "similarity_pairs_lev",
    f"""WITH p AS (SELECT DISTINCT lower(name) AS a, lower(category) AS b FROM ({inputs.DIRTY_PART}) x)
        SELECT a, b, CAST(1.0 AS DOUBLE) - CAST(levenshtein(a, b) AS DOUBLE)
          / greatest(length(a), length(b)) AS ratio FROM p""",
)
def similarity_pairs_lev(spark, folder):
    pairs = _name_pairs(spark, folder)
    return pairs.withColumn("ratio", levenshtein_similarity(F.col("a"), F.col("b")))


_HEALTH = f"""
    s AS (SELECT product_id, CAST(sum(CAST(quantity AS DECIMAL(18,4))) AS DOUBLE) AS units,
            CAST(count(*) FILTER (returned) AS DOUBLE) / count(*) AS rate
          FROM ({inputs.ITEMS}) i GROUP BY product_id),
    v AS (SELECT product_id, CAST(sum(stock) AS DOUBLE) AS stock FROM ({inputs.INVENTORY}) y
          WHERE product_id % 17 <> 0 GROUP BY product_id),
    j AS (SELECT p.product_id, p.name, CASE WHEN price > 0 THEN (price - cost) / price END AS margin,
            units, rate, stock
          FROM ({inputs.PRODUCTS}) p LEFT JOIN s ON p.product_id = s.product_id
          LEFT JOIN v ON p.product_id = v.product_id),
    f AS (SELECT *,
        CASE WHEN margin >= CAST(0.5 AS DOUBLE) THEN 20 WHEN margin >= CAST(0.3 AS DOUBLE) THEN 10
             WHEN margin >= CAST(0.15 AS DOUBLE) THEN 0 ELSE -15 END AS mp,
        CASE WHEN units > 100 THEN 20 WHEN units >= 25 THEN 10 WHEN units > 0 THEN 0 ELSE -15 END AS up,
        CASE WHEN rate <= CAST(0.03 AS DOUBLE) THEN 10 WHEN rate <= CAST(0.08 AS DOUBLE) THEN 0
             WHEN rate <= CAST(0.15 AS DOUBLE) THEN -15 ELSE -25 END AS rp,
        CASE WHEN stock = 0 THEN -20 WHEN stock < 10 THEN -5 WHEN stock > 500 THEN -5 ELSE 10 END AS sp
      FROM j),
    h AS (SELECT *, CAST(greatest(0, least(100, 50 + mp
        + CASE WHEN units IS NULL THEN 0 ELSE up END + CASE WHEN rate IS NULL THEN 0 ELSE rp END
        + CASE WHEN stock IS NULL THEN 0 ELSE sp END)) AS INTEGER) AS score FROM f)"""


def _scored(spark, folder):
    stocked = inputs.inventory(spark, folder).where("product_id % 17 <> 0")
    signals = scoring.product_signals(inputs.items(spark, folder), stocked)
    return scoring.product_health(inputs.products(spark, folder), signals)


@query(
    "product_health",
    f"""WITH {_HEALTH} SELECT product_id, name AS product_name, score AS health_score,
          CASE WHEN score >= 80 THEN 'Promote / Feature: High performer with solid fundamentals'
               WHEN score >= 60 THEN 'Maintain: Stable performer'
               WHEN score >= 40 THEN 'Review: Investigate low margins or return rate issues'
               ELSE 'Intervene: High risk of loss, stockout, or customer dissatisfaction' END
            AS recommendation,
          CAST(1 + (units IS NOT NULL)::INT + (rate IS NOT NULL)::INT + (stock IS NOT NULL)::INT AS INTEGER)
            AS factor_count,
          concat_ws('; ',
            CASE WHEN units IS NULL THEN 'Sales transaction history not provided' END,
            CASE WHEN rate IS NULL THEN 'Return data not linked for this product' END,
            CASE WHEN stock IS NULL THEN 'Inventory level not provided' END) AS missing FROM h""",
)
def product_health(spark, folder):
    return _scored(spark, folder).select(
        "product_id",
        "product_name",
        "health_score",
        "recommendation",
        F.size("contributing_factors").alias("factor_count"),
        F.array_join("missing_evidence", "; ").alias("missing"),
    )


_PCT = "CAST(round(CAST({x} * 100 AS DECIMAL(28,8)), 1) AS DECIMAL(28,1)) || '%)'"
_WHOLE = "CAST(CAST({x} AS DECIMAL(38,0)) AS VARCHAR)"


@query(
    "product_health_factors",
    f"""WITH {_HEALTH}
        SELECT product_id, 'Gross Margin' AS factor, CAST(mp AS INTEGER) AS points,
          CASE mp WHEN 20 THEN 'Strong' WHEN 10 THEN 'Healthy' WHEN 0 THEN 'Moderate' ELSE 'Low' END
            || ' gross margin (' || {_PCT.format(x='margin')} AS reason FROM h
        UNION ALL SELECT product_id, 'Sales Velocity', up,
          CASE up WHEN 20 THEN 'High' WHEN 10 THEN 'Moderate' ELSE 'Slow' END
            || ' sales volume (' || {_WHOLE.format(x='units')} || ' units)' FROM h WHERE units IS NOT NULL
        UNION ALL SELECT product_id, 'Return Rate', rp,
          CASE rp WHEN 10 THEN 'Very low' WHEN 0 THEN 'Acceptable' WHEN -15 THEN 'Elevated'
            ELSE 'Critical' END || ' return rate (' || {_PCT.format(x='rate')} FROM h WHERE rate IS NOT NULL
        UNION ALL SELECT product_id, 'Stock Level', sp,
          CASE WHEN stock = 0 THEN 'Out of stock (lost sales risk)'
               WHEN stock < 10 THEN 'Critically low stock (' || {_WHOLE.format(x='stock')} || ' units left)'
               WHEN stock > 500 THEN 'Potential overstocking (' || {_WHOLE.format(x='stock')} || ' units on hand)'
               ELSE 'Optimal stock coverage (' || {_WHOLE.format(x='stock')} || ' units on hand)' END
          FROM h WHERE stock IS NOT NULL""",
)
def product_health_factors(spark, folder):
    return scoring.health_factors(_scored(spark, folder))


_SEGMENTS = f"""WITH g AS (SELECT CAST(customer_id AS VARCHAR) AS customer_id,
        count(*) AS frequency_orders,
        CAST(round(sum({MONEY.format(c='total_amount')}), 2) AS DECIMAL(38,2)) AS monetary_spend,
        max(CAST(order_date AS DATE)) AS last_order
      FROM ({inputs.ORDERS}) o GROUP BY customer_id)
    SELECT customer_id, frequency_orders, monetary_spend,
      CASE WHEN frequency_orders >= 5 AND monetary_spend >= 500 THEN 'Champion'
           WHEN frequency_orders >= 3 OR monetary_spend >= 250 THEN 'Loyal Customer'
           WHEN frequency_orders = 1 AND monetary_spend < 100 THEN 'Occasional / Low Value'
           ELSE 'Regular Customer' END AS segment,
      'Calculated from ' || frequency_orders || ' orders totaling $' || monetary_spend
        AS audit_evidence"""


@query("customer_segments", f"{_SEGMENTS} FROM g")
def customer_segments(spark, folder):
    return scoring.customer_segments(inputs.orders(spark, folder))


@query(
    "customer_segments_recency",
    f"""{_SEGMENTS}, CAST(date_diff('day', last_order, (SELECT max(last_order) FROM g)) AS INTEGER)
        AS recency_days FROM g""",
)
def customer_segments_recency(spark, folder):
    return scoring.customer_segments(inputs.orders(spark, folder), recency=True)


