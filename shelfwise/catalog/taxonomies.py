"""Queries over names: by a taxonomy that is a table, and pairs of similar ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.catalog import sql
from shelfwise.catalog.inputs import table
from shelfwise.catalog.registry import query
from shelfwise.operators import taxonomy, variants

# A taxonomy out of the table itself: each product name and each of its last words.
_TERMS = """
SELECT p_name AS term, concat('Goods ', p_name) AS name, p_size AS place FROM {part}
UNION ALL
SELECT split_part(p_name, ' ', 2), concat('All ', split_part(p_name, ' ', 2)), 1000 + p_size FROM {part}
"""
_SPELLED = """
SELECT p_partkey AS product_id,
  CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN concat('the ', upper(p_name), ', new')
    WHEN 2 THEN concat(substr(p_name, 1, 2), substr(p_name, 4))
    WHEN 3 THEN concat(split_part(p_name, ' ', 1), 'ish ', lower(p_type))
    WHEN 4 THEN concat(p_type, ' un', split_part(p_name, ' ', 2), 'able') END AS raw
FROM {part}
"""


def _sql(kind: str, match: str) -> str:
    category = kind == "category"
    if not category:
        inside, rank = "false", "place"
    elif match == "longest":
        inside, rank = "regexp_matches(text, '(^|[^a-z0-9-])' || term || '($|[^a-z0-9-])')", "length(term) DESC, place"
    else:
        inside, rank = "contains(text, term)", "place"
    least, near, lead = ("0.80", "ratio DESC, place", "Fuzzy matched") if category else ("0.85", "place", "Fuzzy matched to")
    none, missing, low, unknown = (
        ("Uncategorized", "Missing category", "0.6", "Low confidence match; original preserved") if category
        else ("Unknown", "Missing brand", "0.75", "Brand not in canonical taxonomy")
    )
    return f"""
WITH t AS (SELECT lower(term) AS term, min(place) AS place, arg_min(name, (place, name)) AS name
           FROM ({_TERMS.format(part='part')}) x GROUP BY lower(term)),
     r AS ({_SPELLED.format(part='part')}),
     d AS (SELECT DISTINCT lower(trim(raw)) AS text FROM r WHERE trim(raw) <> ''),
     e AS (SELECT text, name, 1.0 AS confidence, NULL AS note FROM d JOIN t ON text = term),
     c AS (SELECT text, name, 0.9 AS confidence, 'Substring matched ''' || term || '''' AS note FROM d JOIN t ON {inside}
           WHERE text NOT IN (SELECT text FROM e) QUALIFY row_number() OVER (PARTITION BY text ORDER BY {rank}) = 1),
     f AS (SELECT text, name, place, 1.0::DOUBLE - levenshtein(text, term)::DOUBLE / greatest(length(text), length(term)) AS ratio
           FROM d, t WHERE text NOT IN (SELECT text FROM e UNION ALL SELECT text FROM c)),
     g AS (SELECT text, name, round(ratio, 2) AS confidence, '{lead} ''' || name || ''' ('
             || regexp_replace(printf('%.2f', round(ratio, 2)), '0$', '') || ')' AS note
           FROM f WHERE ratio >= {least} QUALIFY row_number() OVER (PARTITION BY text ORDER BY {near}) = 1),
     a AS (SELECT * FROM e UNION ALL SELECT * FROM c UNION ALL SELECT * FROM g)
SELECT product_id, coalesce(name, CASE WHEN raw IS NULL THEN '{none}' ELSE {sql.initcap('trim(raw)')} END) AS value,
  coalesce(confidence, CASE WHEN raw IS NULL THEN 0.0 ELSE {low} END)::DOUBLE AS confidence,
  CASE WHEN raw IS NULL THEN '{missing}' WHEN name IS NULL THEN '{unknown}' ELSE note END AS note
FROM r LEFT JOIN a ON lower(trim(raw)) = text
"""


def _normalized(spark, folder, kind: str, match: str):
    part = table(spark, folder, "part")
    terms = spark.sql(_TERMS.format(part="{part}"), part=part)
    texts = spark.sql(_SPELLED.format(part="{part}"), part=part)
    found = taxonomy.normalize_by(texts, "raw", terms, kind, match, measure="levenshtein")
    return found.select(
        "product_id", F.col("raw_value").alias("value"), F.col("raw_confidence").alias("confidence"), F.col("raw_note").alias("note")
    )


@query("taxonomy_category_longest", _sql("category", "longest"))
def taxonomy_category_longest(spark, folder):
    return _normalized(spark, folder, "category", "longest")


@query("taxonomy_category_first", _sql("category", "first"))
def taxonomy_category_first(spark, folder):
    return _normalized(spark, folder, "category", "first")


@query("taxonomy_brand", _sql("brand", "first"))
def taxonomy_brand(spark, folder):
    return _normalized(spark, folder, "brand", "first")


_NAMES = "SELECT DISTINCT lower(trim(raw)) AS key FROM (" + _SPELLED + ") x WHERE raw IS NOT NULL"


@query(
    "similar_names",
    f"""WITH k AS ({_NAMES.format(part='part')}), p AS (SELECT x.key AS a, y.key AS b,
            1.0::DOUBLE - levenshtein(x.key, y.key)::DOUBLE / greatest(length(x.key), length(y.key)) AS ratio
          FROM k x JOIN k y ON x.key < y.key AND abs(length(x.key) - length(y.key)) <= 2)
        SELECT * FROM p WHERE ratio >= 0.82""",
)
def similar_names(spark, folder):
    keys = spark.sql(_NAMES.format(part="{part}"), part=table(spark, folder, "part"))
    pairs = variants.similar_keys(keys.withColumn("grp", F.lit(0)), 0.82, measure="levenshtein")
    return pairs.select("a", "b", "ratio")
