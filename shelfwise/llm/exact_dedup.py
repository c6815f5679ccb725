"""Exact dedup by sorting content.

Sampled splitters deal texts to ranges by their normalised bytes, an external
sort puts equal ones side by side, and each row is compared in full with its
neighbours: a window partitioned by the text itself. The first bytes and a hash
stand for the text where ranges are cut, so that the sample stays small however
long texts are. Nothing but DataFrame operations runs.

Texts that very many rows hold are counted first, by hash. Only their rows take
a further key, a hash of the id, which cuts a group into runs of bounded size;
the runs of one text, a few rows each, are joined through its digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.batches import staged, tasks

#: Rows of one text from which it is dealt to runs of about so many, and texts that are, at most.
RUN_ROWS, MOST_CUT = 4_096, 10_000
#: Characters of a text that splitters are made of; a hash of the whole text splits longer common heads.
SPLITTER_CHARS = 32

# Only these letters are folded.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def _sorted_runs(df: DataFrame, id_col: str, text_col: str, carried: list[Column]) -> tuple[DataFrame, list[str]]:
    """Rows with equal texts side by side, and the names of the columns that tell runs apart."""
    content = normalised(df[text_col])
    rows = df.select(
        df[id_col].cast("long").alias("doc_id"),
        df[text_col].cast("string").alias("text"),
        *carried,
        F.substring(content, 1, SPLITTER_CHARS).alias("head"),
        F.xxhash64(content).alias("tie"),
    )
    # A text is cut if it has more than this share of all rows, so no more than MOST_CUT can be.
    least = max(RUN_ROWS, -(-df.count() // MOST_CUT))
    crowded = rows.groupBy("tie").agg(F.count("*").alias("crowd")).where(F.col("crowd") > least)
    runs = F.ceil(F.col("crowd") / least)
    dealt = (
        rows.join(F.broadcast(crowded), "tie", "left")
        .withColumn("cut", F.col("crowd").isNotNull())
        .withColumn("salt", F.when(F.col("cut"), F.pmod(F.xxhash64("doc_id"), runs)).otherwise(0))
        .drop("crowd")
    )
    # The sort is by the text itself, which is folded again rather than sent twice.
    ordered = dealt.repartitionByRange(tasks(df), "head", "tie", "salt").withColumn("content", normalised(F.col("text")))
    return ordered, ["head", "tie", "salt", "content"]


def _digest() -> Column:
    return F.sha2(F.col("content").cast("binary"), 256)


def exact_duplicates(
    df: DataFrame, keep: str = "last", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``df``.

    ``keep`` names the row of a group that stays: "first" for the smallest id,
    "last" for the largest. Null text counts as empty and equals empty text.
    Rows of equal id are counted each, and one of those with the id that stays
    is kept. A null id stays only if its group has no other. An empty table gives
    no rows; further columns are ignored. Texts are compared whole.
    """
    best = F.max if keep == "last" else F.min
    ordered, run = _sorted_runs(df, id_col, text_col, [])
    equal = Window.partitionBy(*run)
    by_id = equal.orderBy("doc_id")
    runs = staged(
        ordered.select(
            "doc_id",
            "cut",
            _digest().alias("text_sha256"),
            F.row_number().over(by_id).alias("place"),
            # 0 for the first of rows with one id, which fall into one run
            (F.row_number().over(by_id) - F.rank().over(by_id)).alias("again"),
            best("doc_id").over(equal).alias("run_keep"),
            F.count("*").over(equal).alias("run_size"),
        ),
        "runs",
    )
    # Of cut texts only: a row each, MOST_CUT at most.
    groups = (
        runs.where("cut AND place = 1")
        .groupBy("text_sha256")
        .agg(best("run_keep").alias("all_keep"), F.sum("run_size").alias("all_size"))
    )
    found = runs.join(F.broadcast(groups), "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("cut"), F.col("all_keep")).otherwise(F.col("run_keep")).alias("keep_id"),
        F.when(F.col("cut"), F.col("all_size")).otherwise(F.col("run_size")).alias("group_size"),
        "again",
        "text_sha256",
    )
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("again") == 0)).alias("kept"),
        "text_sha256",
    )


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all its columns: of equal texts that of the smallest id.

    The same rules as in ``exact_duplicates``. Of rows that share id and text,
    the one with the least hash of all columns stays. Texts are sent once.
    """
    columns = F.struct(*[df[c] for c in df.columns if c != text_col])
    ordered, run = _sorted_runs(df, id_col, text_col, [columns.alias("rest")])
    # The smallest id, or null where there is no other.
    order = [F.asc_nulls_last("doc_id"), F.xxhash64(F.to_json("rest"))]
    winners = ordered.withColumn("place", F.row_number().over(Window.partitionBy(*run).orderBy(*order))).where("place = 1")
    winners = staged(winners.select("doc_id", "text", "rest", "cut", F.when(F.col("cut"), _digest()).alias("digest")), "winners")
    # A row per run of a cut text; the others are settled.
    last = Window.partitionBy("digest").orderBy(*order)
    cut = winners.where("cut").withColumn("place", F.row_number().over(last)).where("place = 1").drop("place")
    kept = winners.where("NOT cut").unionByName(cut)
    named = [(F.col("text") if c == text_col else F.col("rest")[c]).alias(c) for c in df.columns]
    return kept.select(*named)
