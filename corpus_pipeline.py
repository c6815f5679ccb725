"""A training corpus out of raw documents, one operator of the package per stage.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and returns a DataFrame that is written as Parquet and read again for the next.
All but the last return the columns of ``documents``; rows may repeat ids, and
columns of other names are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm import chosen_path, decontamination, exact_dedup, language, packing
from shelfwise.llm.catalog import vocabulary
from shelfwise.session import scratch_path

#: Share of the shortest code below which a document's language is not told apart.
LEAST_SCORE = 0.5


def _picked(docs: DataFrame, text_key, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (__id, __text) names, one for each of them."""
    own = docs.withColumns({"__id": F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))), "__text": text_key})
    # Rows that share id and text go by the rest of their columns.
    first = Window.partitionBy("__id", "__text").orderBy(F.xxhash64(F.to_json(F.struct(*[docs[c] for c in docs.columns if c != "text"]))))
    return (
        own.join(decisions, ["__id", "__text"], "left_semi")
        .withColumn("__nth", F.row_number().over(first))
        .where("__nth = 1")
        .drop("__id", "__text", "__nth")
    )


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null text and text without letters go.

    Without a labelled row no language is known, and all text with letters stays.
    """
    model = language.fit(docs)
    if model is None:
        return docs.where(docs["text"].cast("string").rlike(r"\p{L}"))
    found = docs.withColumn("__language", language.language_of(spark, model, docs["text"]))
    keep = (F.col("__language.lang") != language.UNKNOWN) & (F.col("__language.score") >= LEAST_SCORE)
    return found.where(keep).drop("__language")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the smallest id."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id. Rows without words stay."""
    kept = chosen_path.near_duplicates(docs, marks=True).where("kept")
    decisions = kept.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("__id"), F.col("mark").alias("__text"))
    return _picked(docs, F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))), decisions)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no near copy of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = docs.withColumn("__found", decontamination.benchmark_matches(docs["text"].cast("string"), benchmark))
    return found.where(F.size("__found") == 0).drop("__found")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and place."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: Language models and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark, "corpus")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
