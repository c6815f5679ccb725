"""Spelling variants: similar pairs and the map from variant to main form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.similarity import levenshtein_similarity, similarity
from shelfwise.functions.text import name_col, strip, title_case
from shelfwise.operators import segments
from shelfwise.session import stage

# Fixed values.
MERGE_RATIO = 0.85
SUSPECT_RATIO = 0.82
LENGTH_GAP = 2

MAP_SCHEMA = T.StructType(
    [T.StructField("variant", T.StringType()), T.StructField("canonical", T.StringType())]
)


def _prefix_tokens(keys: DataFrame, ratio: float, gap: int) -> DataFrame:
    """(grp, key, token): the rarest bigrams of each key, enough of them that
    two keys at or above ``ratio`` must share one.

    A matching-blocks ratio r leaves at most (1-r)(la+lb) characters outside
    the blocks, so that many single insertions and deletions turn one text
    into the other. A deletion destroys two bigrams of the padded text and an
    insertion one. With lengths at most ``gap`` apart that is at most
    1.5(1-r)(2la-gap) + gap/2 bigrams: one more than that, taken rarest first
    by the same order everywhere, must contain a common bigram. Frequent
    bigrams (a common prefix) come last and so hardly ever form a group.
    """
    padded = F.concat(F.lit("\u0002"), F.col("key"), F.lit("\u0003"))
    grams = F.transform(
        F.sequence(F.lit(1), F.length("key") + 1), lambda i: F.substring(padded, i, F.lit(2))
    )
    # A repeated bigram gets its occurrence number, so that bags compare as sets.
    numbered = F.transform(
        F.col("grams"),
        lambda g, i: F.concat(
            g,
            F.lit("#"),
            F.size(F.filter(F.slice(F.col("grams"), 1, i + 1), lambda h: h == g)).cast("string"),
        ),
    )
    exploded = keys.withColumn("grams", grams).select(
        "grp", "key", F.explode(numbered).alias("token")
    )
    frequency = exploded.groupBy("grp", "token").agg(F.count(F.lit(1)).alias("freq"))
    keep = F.floor(
        1.5 * (1 - ratio) * (2 * F.length("key") - gap) + gap / 2 + 1e-9
    ).cast("int") + 1
    ranked = (
        exploded.join(frequency, ["grp", "token"])
        .groupBy("grp", "key")
        .agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("tokens"))
    )
    return ranked.select(
        "grp",
        "key",
        F.explode(F.slice("tokens", F.lit(1), F.greatest(F.lit(1), keep))).alias("t"),
    ).select("grp", "key", F.col("t.token").alias("token"))


def _may_match(a: Column, b: Column, ratio: float, gap: int) -> Column:
    """Native tests every pair at or above ``ratio`` passes."""
    la, lb = F.length(a), F.length(b)
    reach = F.floor((1 - ratio) * (la + lb) + 1e-9)
    return (F.abs(la - lb) <= gap) & (F.levenshtein(a, b) <= reach)


def _scored(candidates: DataFrame, ratio: float, measure: str) -> DataFrame:
    score = similarity if measure == "blocks" else levenshtein_similarity
    scored = candidates.withColumn("ratio", score(F.col("a"), F.col("b")))
    return scored.where(F.col("ratio") >= ratio)


def similar_keys(
    keys: DataFrame, ratio: float, gap: int = LENGTH_GAP, measure: str = "blocks"
) -> DataFrame:
    """(grp, a, b, ratio) with a < b for all pairs of distinct keys in a group.

    Complete without comparing all pairs: keys of up to ``segments.LONG``
    characters meet in the segment index, longer ones share a rare bigram. A
    native edit-distance test thins candidates out, and only distinct survivors
    reach the similarity function. ``measure="levenshtein"`` uses
    1 - distance / longest length and needs no Python at all.
    """
    met = segments.candidates(keys, ratio, gap)
    # A key near the border meets partners of both kinds.
    grams = _prefix_tokens(keys.where(F.length("key") > segments.LONG - gap), ratio, gap)
    size = F.length("key")
    near = F.sequence(F.greatest(size - gap, F.lit(0)), size + gap)
    left, right = grams.withColumn("size", size), grams.withColumn("size", F.explode(near))
    long = (
        left.withColumnRenamed("key", "a").join(right.withColumnRenamed("key", "b"), ["grp", "token", "size"])
        .where("a < b").select("grp", "a", "b")
    )
    candidates = met.unionByName(long).where(_may_match(F.col("a"), F.col("b"), ratio, gap)).distinct()
    return _scored(candidates, ratio, measure)


def similar_values(
    counts: DataFrame, ratio: float, measure: str = "blocks"
) -> DataFrame:
    """(first, second) pairs of distinct values of (value, n), compared without
    case; ``first`` comes before ``second`` by falling count, then by value."""
    valued = counts.select("value", "n", F.lower("value").alias("key"))
    keys = valued.select(F.lit(0).alias("grp"), "key").distinct()
    pairs = similar_keys(keys, ratio, measure=measure).select("a", "b")
    across = (
        pairs.join(valued.select(F.col("key").alias("a"), F.struct("n", "value").alias("x")), "a")
        .join(valued.select(F.col("key").alias("b"), F.struct("n", "value").alias("y")), "b")
        .select("x", "y")
    )
    # Values that differ in case only; after title-casing these are the few
    # spellings of words of up to four letters.
    x, y = valued.alias("x"), valued.alias("y")
    within = x.join(
        y, (F.col("x.key") == F.col("y.key")) & (F.col("x.value") < F.col("y.value"))
    ).select(F.struct("x.n", "x.value").alias("x"), F.struct("y.n", "y.value").alias("y"))
    both = across.unionByName(within)
    x_first = (F.col("x.n") > F.col("y.n")) | (
        (F.col("x.n") == F.col("y.n")) & (F.col("x.value") < F.col("y.value"))
    )

    def ordered(first, second):
        return F.struct(
            F.col(f"{first}.n").alias("first_n"),
            F.col(f"{first}.value").alias("first"),
            F.col(f"{second}.value").alias("second"),
        )

    return both.select(F.when(x_first, ordered("x", "y")).otherwise(ordered("y", "x")).alias("p")).select("p.*")


def _settle_in_rounds(pairs: DataFrame) -> DataFrame:
    """The map of a walk in the given order, in which each unclaimed value claims
    its later neighbours, by rounds of joins for any number of pairs.

    A value that comes second in no open pair stands; all it is paired with is
    claimed. Pairs of claimed values close, and the rest goes to the next
    round. Afterwards each claimed value takes the earliest standing one.
    """
    pairs = stage(pairs, "variant-pairs")
    open_pairs = pairs
    claimed_sets = []
    while not open_pairs.isEmpty():
        seconds = open_pairs.select(F.col("second").alias("first")).distinct()
        claimed = stage(
            open_pairs.join(seconds, "first", "left_anti").select("second").distinct(),
            "variant-claimed",
        )
        claimed_sets.append(claimed)
        open_pairs = stage(
            open_pairs.join(claimed, "second", "left_anti").join(
                claimed.withColumnRenamed("second", "first"), "first", "left_anti"
            ),
            "variant-open",
        )
    if not claimed_sets:
        return pairs.sparkSession.createDataFrame([], MAP_SCHEMA)
    claimed = claimed_sets[0]
    for more in claimed_sets[1:]:
        claimed = claimed.unionByName(more)
    standing = pairs.join(claimed.withColumnRenamed("second", "first"), "first", "left_anti")
    earliest = F.min(F.struct((-F.col("first_n")).alias("rank"), F.col("first")))
    return (
        standing.groupBy("second")
        .agg(earliest.alias("best"))
        .select(F.col("second").alias("variant"), F.col("best.first").alias("canonical"))
    )


def variant_map(counts: DataFrame, ratio: float = MERGE_RATIO, measure: str = "blocks") -> DataFrame:
    """(variant, canonical) from (value, n)."""
    return _settle_in_rounds(similar_values(stage(counts, "value-counts"), ratio, measure))


def harmonize(
    df: DataFrame, column: str, measure: str = "blocks", ratio: float = MERGE_RATIO
) -> DataFrame:
    """Title-case a category column and merge variants into the more frequent form."""
    titled = df.withColumn(column, title_case(name_col(column)))
    counts = (
        titled.where(name_col(column).isNotNull())
        .groupBy(name_col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    mapping = variant_map(counts, ratio, measure).select(
        F.col("variant").alias("__variant"), F.col("canonical").alias("__canonical")
    )
    joined = titled.join(mapping, name_col(column) == F.col("__variant"), "left")
    return joined.withColumn(column, F.coalesce("__canonical", name_col(column))).drop("__variant", "__canonical")


def case_variants(counts: DataFrame) -> DataFrame:
    """(column, key, variants, n): trimmed values that differ only in case."""
    trimmed = counts.withColumn("value", strip(F.col("value"))).where(F.col("value") != "")
    spelled = trimmed.groupBy("column", "value").agg(F.sum("n").alias("n"))
    return (
        spelled.groupBy("column", F.lower("value").alias("key"))
        .agg(
            F.count(F.lit(1)).alias("variant_count"),
            F.sort_array(F.collect_list("value")).alias("variants"),
            F.sum("n").alias("n"),
        )
        .where("variant_count > 1")
    )
