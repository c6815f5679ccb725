"""Candidate pairs of similar texts from an index of segments.

Two texts of lengths a and b at or above a ratio leave at most
``over = (1 - ratio)(a + b)`` characters outside their common part. A join key
always carries both lengths, so that each bound is that of the very pair.

* Short texts: with ``over`` known, both sides know how many characters they
  lose, so exactly that many deletions make them equal.
* Longer texts: the longer of two is cut into up to ``over + 6`` segments. Each
  character left over spoils one segment at most, so all segments but ``over``
  occur in the other text, shifted by no more than the characters left over. As
  many as there are beyond ``over + 1`` may therefore be dropped: the most
  frequent ones, such as those of a word that many texts share.

Texts that share most of their characters meet in what they share. Where the
ratio makes nearly all of them similar (numbered names with a long common part),
the pairs asked for are as many themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Segments cut beyond the fewest, and dropped where most frequent; a segment keeps two characters.
SPARE = 5
#: Length up to which texts are cut into segments.
LONG = 64


def left_over(a: Column, b: Column, ratio: float) -> Column:
    """Characters outside the common part, at most. Their number is even exactly if a + b is."""
    most = F.floor((1 - ratio) * (a + b) + 1e-9).cast("int")
    return most - (a + b - most) % 2


def _left_over(a: int, b: int, ratio: float) -> int:
    most = int((1 - ratio) * (a + b) + 1e-9)
    return most - (a + b - most) % 2


def short_length(ratio: float, gap: int) -> int:
    """The greatest length up to which nobody loses more than two characters, 14 at most."""

    def most(length: int) -> int:
        pairs = ((length, other) for other in range(max(0, length - gap), length + 1))
        return max((_left_over(a, b, ratio) + a - b) // 2 for a, b in pairs if _left_over(a, b, ratio) >= a - b)

    length = 0
    while length < 14 and most(length + 1) <= 2:
        length += 1
    return length


def _without_one(text: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.transform(
        places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))
    )


def deletion_tokens(keys: DataFrame, ratio: float, gap: int, short: int) -> tuple[DataFrame, DataFrame]:
    """(grp, key, a, b, token) of the shorter side, of length a, and of the longer one, of length b."""
    own = F.length("key")
    held = keys.where(own <= short)
    sides = (
        held.select("grp", "key", own.alias("a"), F.explode(F.sequence(own, F.least(own + gap, F.lit(short)))).alias("b")),
        held.select("grp", "key", F.explode(F.sequence(F.greatest(own - gap, F.lit(0)), own)).alias("a"), own.alias("b")),
    )
    out = []
    for side, length in zip(sides, ("a", "b")):
        over = left_over(F.col("a"), F.col("b"), ratio)
        lost = F.expr(length) - ((F.col("a") + F.col("b") - over) / 2).cast("int")
        once = _without_one(F.col("key"))
        left = F.when(lost == 0, F.array("key")).when(lost == 1, once).otherwise(F.flatten(F.transform(once, _without_one)))
        tokens = F.explode(F.array_distinct(left)).alias("token")
        out.append(side.where(over >= F.col("b") - F.col("a")).select("grp", "key", "a", "b", tokens))
    return out[0], out[1]


def _fewest(b: Column, ratio: float) -> Column:
    """Segments of a text of length b of which any partner that is not longer leaves one whole."""
    return F.floor((1 - ratio) * 2 * b + 1e-9).cast("int") + 1


def _cuts(b: Column, ratio: float) -> Column:
    fewest = _fewest(b, ratio)
    return F.greatest(fewest, F.least(fewest + SPARE, F.floor(b / 2).cast("int")))


def _segments(keys: DataFrame, ratio: float, short: int) -> DataFrame:
    """(grp, key, b, i, seg): all segments of the longer sides, of nearly one length."""
    b = F.length("key")
    cuts = _cuts(b, ratio)
    at = lambda i: F.floor(i * F.col("b") / F.col("cuts")).cast("int")
    return (
        keys.where((b > short) & (b <= LONG)).withColumns({"b": b, "cuts": cuts})
        .select("grp", "key", "b", "cuts", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.col("cuts") - 1),
            lambda i: F.substring(F.col("key"), at(i) + 1, at(i + 1) - at(i)),
        )).alias("i", "seg"))
        .drop("cuts")
    )


def _probes(keys: DataFrame, ratio: float, gap: int, short: int) -> DataFrame:
    """(grp, key, b, i, seg): what a partner of length b, not shorter than the key, may have as its i-th segment."""
    a = F.length("key")
    to = F.explode(F.sequence(F.greatest(a, F.lit(short + 1)), F.least(a + gap, F.lit(LONG))))
    sided = keys.where((a > short - gap) & (a <= LONG)).select("grp", "key", a.alias("a"), to.alias("b"))
    over = left_over(F.col("a"), F.col("b"), ratio)
    sided = sided.withColumns({"over": over, "cuts": _cuts(F.col("b"), ratio)}).where("over >= b - a")
    each = sided.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    start = F.floor(F.col("i") * F.col("b") / F.col("cuts")).cast("int")
    size = F.floor((F.col("i") + 1) * F.col("b") / F.col("cuts")).cast("int") - start
    # Left and right of the segment together, no more than ``over`` is left over.
    apart = F.col("a") - F.col("b")
    low = F.greatest(start + F.ceil((apart - F.col("over")) / 2).cast("int"), F.lit(0))
    high = F.least(start + F.floor((apart + F.col("over")) / 2).cast("int"), F.col("a") - size)
    found = F.transform(F.sequence(low, high), lambda p: F.substring(F.col("key"), p + 1, size))
    return each.where(low <= high).select("grp", "key", "b", "i", F.explode(F.array_distinct(found)).alias("seg"))


def segment_tokens(keys: DataFrame, ratio: float, gap: int, short: int) -> tuple[DataFrame, DataFrame]:
    """(grp, key, b, i, seg) of the shorter and of the longer side."""
    place = ["grp", "b", "i", "seg"]
    segments = _segments(keys, ratio, short)
    frequency = segments.groupBy(place).agg(F.count("*").alias("freq"))
    longer = (
        segments.join(frequency, place).groupBy("grp", "key", "b")
        .agg(F.sort_array(F.collect_list(F.struct("freq", "i", "seg"))).alias("s"))
        .select("grp", "key", "b", F.explode(F.slice("s", F.lit(1), _fewest(F.col("b"), ratio))).alias("t"))
        .select("grp", "key", "b", "t.i", "t.seg")
    )
    return _probes(keys, ratio, gap, short), longer


def candidates(keys: DataFrame, ratio: float, gap: int) -> DataFrame:
    """(grp, a, b): pairs of keys of at most ``LONG`` characters, at most ``gap`` apart in length; may repeat.

    All pairs at or above ``ratio`` are among them, be it twice the matching
    part over both lengths or 1 - edit distance over the longer length.
    """
    short = short_length(ratio, gap)
    shorter, longer = deletion_tokens(keys, ratio, gap, short)
    met = shorter.alias("x").join(longer.alias("y"), ["grp", "a", "b", "token"]).where("x.key <> y.key")
    out = met.select("grp", F.col("x.key").alias("p"), F.col("y.key").alias("q"))
    shorter, longer = segment_tokens(keys, ratio, gap, short)
    met = shorter.alias("x").join(longer.alias("y"), ["grp", "b", "i", "seg"]).where("x.key <> y.key")
    out = out.unionByName(met.select("grp", F.col("x.key").alias("p"), F.col("y.key").alias("q")))
    return out.select("grp", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
