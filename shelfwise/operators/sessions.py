"""Filters carried along the turns of a session."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1_000


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[Column | str],
    values: Mapping[str, Column],
) -> DataFrame:
    """Adds, per name in ``values``, the sum of its column up to each row of a key.

    ``block`` splits a key's rows into ordered pieces. Each piece is summed on
    its own and shifted by what the pieces before it add up to, so a key with
    very many rows is never one task's work.
    """
    df = df.withColumns({"__block": block, **{f"__v_{n}": v for n, v in values.items()}})
    sums = df.groupBy(*keys, "__block").agg(
        *[F.sum(f"__v_{n}").alias(f"__sum_{n}") for n in values]
    )
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = sums.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.col("__block").alias("__b"),
        *[
            F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__shift_{n}")
            for n in values
        ],
    )
    match = F.col("__block") == F.col("__b")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    within = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = df.join(shifts, match).withColumns(
        {n: F.sum(f"__v_{n}").over(within) + F.col(f"__shift_{n}") for n in values}
    )
    extra = [f"__{part}_{n}" for n in values for part in ("v", "shift")]
    return summed.drop("__block", "__b", *extra, *[f"__{k}" for k in keys])


def _last_of_each_field(lists: Column, empty: Column) -> Column:
    """Lists of filters (structs with a ``field``) in order, folded into one: a
    list takes the place of all earlier filters on the fields it names."""

    def fold(held, more):
        older = F.filter(held, lambda h: ~F.exists(more, lambda m: m["field"].eqNullSafe(h["field"])))
        return F.concat(older, more)

    return F.aggregate(lists, empty, fold)


def session_filters(
    turns: DataFrame, block: int = BLOCK, distinct_fields: bool = False
) -> DataFrame:
    """Adds the segment, the accumulated and the effective filters of each turn.

    ``turns`` has session_id, turn, follow_up and filters (an array). A
    follow-up adds its filters to what is accumulated; another turn replaces
    it if it has filters and leaves it if it has none. A segment starts at
    each replacement. ``distinct_fields`` keeps, of filters (structs with a
    ``field``), only those of the last turn that names a field; null fields are
    one field.

    What a turn holds is an associative fold, so it is taken in two levels:
    over the turns of a block of a session, then over the blocks' last values.
    ``block`` is how many turn numbers a block spans; a session of any length is
    no one task's work but for one row per block. Turns are shuffled once by
    block, the block values once by session and once back.
    """
    kind = turns.schema["filters"].dataType
    empty = F.array().cast(kind)

    def folded(lists):
        return _last_of_each_field(lists, empty) if distinct_fields else F.flatten(lists)

    key = ["session_id", "__block"]
    own = F.coalesce("filters", empty)
    df = turns.withColumns({"filters": own, "__block": F.floor(F.col("turn") / block)})
    filled = F.size("filters") > 0
    upto = (Window.unboundedPreceding, Window.currentRow)
    within = Window.partitionBy(*key).orderBy("turn").rowsBetween(*upto)
    replaced = (~F.col("follow_up") & filled).cast("bigint")
    local = df.withColumn("__resets", F.sum(replaced).over(within))
    part = Window.partitionBy(*key, "__resets").orderBy("turn").rowsBetween(*upto)
    local = local.withColumn("__lists", F.collect_list(F.when(filled, F.col("filters"))).over(part))

    # One row per block: how often it replaced, and what it holds at its end.
    last = local.groupBy(*key).agg(F.max_by(F.struct("__resets", "__lists"), "turn").alias("e"))
    ends = last.select(*key, F.col("e.__resets").alias("__n"), folded(F.col("e.__lists")).alias("__end"))
    before = Window.partitionBy("session_id").orderBy("__block")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({
        "__shift": F.coalesce(F.sum("__n").over(earlier), F.lit(0)),
        "__since": F.sum(F.when(F.col("__n") > 0, 1).otherwise(0)).over(before.rowsBetween(*upto)),
    })
    since = Window.partitionBy("session_id", "__since").orderBy("__block").rowsBetween(*upto)
    ends = ends.withColumn("__out", folded(F.collect_list("__end").over(since)))
    ends = ends.withColumn("__in", F.coalesce(F.lag("__out").over(before), empty))
    carried = ends.select(F.col("session_id").alias("__s"), F.col("__block").alias("__b"), "__shift", "__in")

    same = F.col("session_id").eqNullSafe(F.col("__s")) & F.col("__block").eqNullSafe(F.col("__b"))
    joined = local.join(carried, same)
    held = F.when(F.col("__resets") > 0, F.col("__lists")).otherwise(F.concat(F.array("__in"), F.col("__lists")))
    effective = F.when(F.col("follow_up"), F.col("accumulated")).otherwise(F.col("filters"))
    return (
        joined.withColumns({"segment": F.col("__resets") + F.col("__shift"), "accumulated": folded(held)})
        .drop("__block", "__resets", "__lists", "__s", "__b", "__shift", "__in")
        .withColumn("effective", effective)
    )
