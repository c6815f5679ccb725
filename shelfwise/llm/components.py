"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.batches import discard, staged


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Edges run from the larger end u to the smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (
        edges.join(least.hint("merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
    )


def components(edges: DataFrame, own: list[str] | None = None) -> DataFrame:
    """(vertex, root): the smallest vertex that each end of an edge is connected to, roots left out.

    ``edges`` has long columns u and v. Neighbours of a vertex hang on its
    smallest one, in turns over larger and over smaller neighbours, until every
    edge points at a root. Each round is a few joins over a table no larger than
    the edges; it is written to the shared folder, so rounds do not pile up, and
    deleted when the next one stands. Joins are merge joins at any size, as small
    tables broadcast in every round pile up on the driver. ``own`` collects the path of the last one.
    """
    spark, last = edges.sparkSession, []
    edges = staged(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", last
    )
    before = None
    while True:
        done, last = last, []
        edges = staged(_small(_large(edges)).distinct(), "edges", last)
        discard(spark, done)
        # An order-free fingerprint of the edges; one row.
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))
        ).first()
        if now == before:
            if own is not None:
                own += last
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        before = now
