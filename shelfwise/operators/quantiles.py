"""Exact percentiles without sorting a column in one task.

An approximate percentile brackets each wanted rank within a proven error.
One more pass counts what lies below the bracket and keeps, counted by value,
only what lies inside it. The window that finds the rank sees a bracket, never
a whole column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 100_000


def exact_percentiles(
    numbers: DataFrame, probabilities: Sequence[float], accuracy: int = ACCURACY
) -> DataFrame:
    """(column, probability, value) from (column, x), linearly interpolated.

    The approximate percentile is off by at most n / accuracy ranks. With
    n > 2 * accuracy a margin of 2 / accuracy covers that and two ranks more;
    below, the bracket is the whole column, at most 2 * accuracy rows.
    """
    numbers = numbers.where(F.col("x").isNotNull())
    margin = 2.0 / accuracy
    edges = [max(0.0, p - margin) for p in probabilities]
    edges += [min(1.0, p + margin) for p in probabilities]
    size = len(probabilities)
    wide = F.col("n") > 2 * accuracy
    lows = [F.when(wide, F.col("edge")[i]).otherwise(F.col("least")) for i in range(size)]
    highs = [F.when(wide, F.col("edge")[size + i]).otherwise(F.col("most")) for i in range(size)]
    bounds = (
        numbers.groupBy("column")
        .agg(
            F.count("x").alias("n"),
            F.min("x").alias("least"),
            F.max("x").alias("most"),
            F.percentile_approx("x", edges, accuracy).alias("edge"),
        )
        .select(
            "column",
            "n",
            *[c.alias(f"low{i}") for i, c in enumerate(lows)],
            *[c.alias(f"high{i}") for i, c in enumerate(highs)],
        )
    )
    x = F.col("x")
    inside = reduce(
        Column.__or__, [(x >= F.col(f"low{i}")) & (x <= F.col(f"high{i}")) for i in range(size)]
    )
    passed = reduce(
        Column.__add__, [(x > F.col(f"high{i}")).cast("int") for i in range(size)]
    )
    # The bounds have one row per column of the table. Each value inside a
    # bracket is counted by itself; all others of one gap between brackets
    # collapse into one group, placed in the order by its least value.
    counted = (
        numbers.join(F.broadcast(bounds), "column")
        .groupBy("column", F.when(inside, -1).otherwise(passed).alias("gap"),
                 F.when(inside, x).alias("value"))
        .agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("x").alias("at"))
    )
    order = Window.partitionBy("column").orderBy("at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = counted.withColumn("upto", F.sum("rows").over(order))

    def ranked(rank):
        """The value at a rank; a rank outside its bracket is an error, never another value."""
        found = F.min(F.when(F.col("upto") > rank, F.struct("at", "value")))
        return F.coalesce(found["value"], F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double"))

    found = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("n") - 1)
        found += [ranked(F.floor(place)).alias(f"b{i}"), ranked(F.ceil(place)).alias(f"a{i}")]
    picked = running.groupBy("column").agg(F.first("n").alias("n"), *found)
    rows = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("n") - 1)
        share = place - F.floor(place)
        value = F.col(f"b{i}") + (F.col(f"a{i}") - F.col(f"b{i}")) * share
        rows.append(F.struct(F.lit(float(p)).alias("probability"), value.alias("value")))
    return picked.select("column", F.inline(F.array(*rows)))
