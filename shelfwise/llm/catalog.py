"""The operators of this package as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.llm import (
    chosen_path,
    decontamination,
    divergence,
    exact_dedup,
    id_files,
    language,
    lexical_search,
    packing,
    recompression,
    substring_repeats,
    token_counts,
    vector_search,
    warc,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op1_substring_repeats")
def op1(spark, folder):
    return substring_repeats.remove_repeats(_table(spark, folder, "documents"), width=200)


@_query("op2_best_fit_packing")
def op2(spark, folder):
    return packing.pack(_table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))




@_query("op3_warc")
def op3(spark, folder):
    return warc.archive_and_read(_table(spark, folder, "pages"))


@_query("op4_recompression")
def op4(spark, folder):
    return recompression.remove_seen(_table(spark, folder, "documents"), width=13)


_EXACT_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
           FROM documents),
     g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM d JOIN g USING (body)
"""


@_query("op5_exact_dedup", _EXACT_SQL)
def op5(spark, folder):
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"), keep="last")


@_query("op6_token_counts")
def op6(spark, folder):
    return token_counts.token_counts(_table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), 2048)


@_query("op9_token_id_files")
def op9(spark, folder):
    return id_files.encode_and_read(_table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


# The characters that end a term, and the letters that are folded.
_NO_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# The components by walking all links; on small tables.
_NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")},
                 '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     i AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM i),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (shingle) WHERE x.doc_id < y.doc_id GROUP BY ALL),
     l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
     e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v, min(u) AS component_id FROM r GROUP BY v) ON v = d.doc_id
"""


@_query("op10_near_duplicates", _NEAR_SQL)
def op10(spark, folder):
    return chosen_path.near_duplicates(_table(spark, folder, "documents"), percent=75, words=5)


@_query("op7_decontamination")
def op7(spark, folder):
    return decontamination.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query("op8_language_id")
def op8(spark, folder):
    return language.predict_languages(_table(spark, folder, "documents"))


_VECTOR_SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
           FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@_query("op12_vector_search", _VECTOR_SQL)
def op12(spark, folder):
    vectors = _table(spark, folder, "embeddings")
    return vector_search.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


_RANKED_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, {_FOLD.format('text')} AS body FROM documents),
     t AS (SELECT d, doc_id, unnest(regexp_extract_all(body, '{_NO_TERM}')) AS term FROM d),
     c AS (SELECT d, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
     z AS (SELECT d, sum(tf)::BIGINT AS n FROM c GROUP BY d),
     g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM z),
     w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
           FROM c, g GROUP BY term, docs),
     b AS (SELECT row_number() OVER () AS i, item_id, {_FOLD.format('text')} AS body FROM benchmark),
     u AS (SELECT i, item_id, unnest(regexp_extract_all(body, '{_NO_TERM}')) AS term FROM b),
     o AS (SELECT i, item_id, term, count(*) AS often FROM u GROUP BY ALL),
     s AS (SELECT i, item_id, d, doc_id,
                  sum(often * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT AS score
           FROM o JOIN w USING (term) JOIN c USING (term) JOIN z USING (d), g GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


@_query("op13_ranked_documents", _RANKED_SQL)
def op13(spark, folder):
    return lexical_search.ranked_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), k=10)


_DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  {_FOLD.format("coalesce(text, '')")} AS body FROM documents),
     g AS (SELECT DISTINCT lang, source FROM d),
     t AS (SELECT d, lang, source, unnest(regexp_extract_all(body, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
     k AS (SELECT lang, term, count(*)::HUGEINT AS whole FROM t GROUP BY ALL HAVING count(DISTINCT d) >= 10),
     v AS (SELECT lang, count(*)::HUGEINT AS width, sum(whole)::HUGEINT AS lang_total FROM k GROUP BY lang),
     o AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
     s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM o GROUP BY ALL),
     r AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 2)) // (coalesce(total, 0) + 2 * width) AS p,
                  1 + (1000000000 * (whole + 2)) // (lang_total + 2 * width) AS q
           FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN o USING (lang, source, term) LEFT JOIN s USING (lang, source)),
     f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
           FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
           UNION ALL
           SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
           WHERE a.lang NOT IN (SELECT lang FROM v)
           UNION ALL
           SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM r WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
WHERE part = 'pair' OR rank <= 10
"""


@_query("op11_source_divergence", _DIVERGENCE_SQL)
def op11(spark, folder):
    return divergence.source_divergence(_table(spark, folder, "documents"), least=10, top=10)
