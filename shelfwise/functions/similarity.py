"""Text similarity."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get these few functions with the task, not from an installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TERM_MATCH = T.StructType(
    [T.StructField("position", T.IntegerType()), T.StructField("ratio", T.DoubleType())]
)


def matcher_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts, the larger of both directions.

    The ratio depends on the order of its two arguments; the larger one makes
    the relation symmetric. Callers pass distinct pairs.
    """
    return pd.Series(
        [
            None if x is None or y is None else max(matcher_ratio(x, y), matcher_ratio(y, x))
            for x, y in zip(a, b)
        ],
        dtype="float64",
    )


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(
        F.lit(1.0) - F.levenshtein(a, b).cast("double") / longest
    )


def closest_term(terms: Sequence[str], threshold: float, first: bool):
    """A vectorized function from text to struct(position, ratio).

    ``first`` takes the first term at or above the threshold, else the best
    one is taken (the earliest on a tie). ``terms`` is a dictionary a caller
    writes down. Null in gives null out, and each text of a batch is compared
    once however often it occurs.
    """
    terms = list(terms)

    def find(text: str, matchers: list[SequenceMatcher]) -> tuple[int | None, float | None]:
        best = (None, threshold)
        for position, matcher in enumerate(matchers):
            matcher.set_seq1(text)
            # Upper bounds of the ratio, by lengths and by letters.
            if matcher.real_quick_ratio() < best[1] or matcher.quick_ratio() < best[1]:
                continue
            ratio = matcher.ratio()
            if ratio >= threshold and (best[0] is None or ratio > best[1]):
                best = (position, ratio)
                if first:
                    break
        return (best[0], round(best[1], 2)) if best[0] is not None else (None, None)

    @F.pandas_udf(TERM_MATCH)
    def apply(texts: pd.Series) -> pd.DataFrame:
        matchers = [SequenceMatcher(None, "", term) for term in terms]
        found = {t: find(t, matchers) for t in texts.dropna().unique()}
        pairs = [found.get(t, (None, None)) for t in texts]
        frame = pd.DataFrame(pairs, columns=["position", "ratio"])
        return frame.astype({"position": "Int32", "ratio": "float64"})

    return apply
