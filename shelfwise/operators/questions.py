"""Screening of question texts and the values mentioned in them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.privacy import has_injection
from shelfwise.functions.text import strip

# Fixed values.
GREETINGS = (
    "hi", "hello", "hey", "help", "who are you", "what can you do", "good morning",
    "good afternoon", "i need your help",
)
EXTERNAL_TOPICS = (
    "weather", "temperature", "inflation", "stock market", "ceo salary", "competitor",
)
VAGUE_QUESTIONS = (
    "what is the best?", "how is the performance?", "tell me about the data", "best item",
)
FOLLOW_UP_PHRASES = (
    "among those", "for these", "filter to", "and also", "then", "now", "what about",
)
REGIONS = ("west", "east", "north", "south", "central")
STATUSES = ("returned", "refunded", "completed", "shipped", "pending", "cancelled")
CATEGORIES = ("apparel", "electronics", "footwear", "home", "beauty")
ID_PATTERN = r"\b([a-z]{3,4}-\d+)\b"
COMPARISON_PATTERN = r"(price|amount|revenue|stock)\s*(>|<|>=|<=|=)\s*(\$?\d+(\.\d+)?)"
TOP_PATTERN = r"top\s*(\d+)"
COMPARISON_NAMES = {">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "=": "eq"}


def _normal(c: Column) -> Column:
    return strip(F.lower(c))


def _contains_any(c: Column, words: Sequence[str]) -> Column:
    found = c.contains(words[0])
    for word in words[1:]:
        found = found | c.contains(word)
    return found


def route(c: Column) -> Column:
    """struct(status, reason): refuse, clarify or ok; the first rule decides."""
    text = _normal(c)
    rules = (
        (has_injection(c), "refuse", "prompt injection"),
        (text.isin(*GREETINGS), "clarify", "greeting"),
        (_contains_any(text, EXTERNAL_TOPICS), "refuse", "external facts"),
        (text.isin(*VAGUE_QUESTIONS), "clarify", "vague"),
    )
    status = F.when(rules[0][0], rules[0][1])
    reason = F.when(rules[0][0], rules[0][2])
    for test, outcome, why in rules[1:]:
        status, reason = status.when(test, outcome), reason.when(test, why)
    return F.struct(status.otherwise("ok").alias("status"), reason.alias("reason"))


def is_follow_up(c: Column, whole_words: bool = True) -> Column:
    """Whether a text takes up the question before it."""
    text = _normal(c)
    if not whole_words:
        return _contains_any(text, FOLLOW_UP_PHRASES)
    phrases = "|".join(re.escape(p).replace(r"\ ", " ") for p in FOLLOW_UP_PHRASES)
    return text.rlike(rf"\b({phrases})\b")


def _mentioned(text: Column, words: Sequence[str]) -> Column:
    listed = F.array(*[F.when(text.contains(w), w) for w in words])
    return F.array_compact(listed)


def _group(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def mentions(c: Column) -> Column:
    """struct of the identifier, regions, states, categories, numeric
    comparison and top-n count that a text mentions."""
    text = _normal(c)
    sign = _group(text, COMPARISON_PATTERN, 2)
    name = None
    for mark, op in COMPARISON_NAMES.items():
        name = F.when(sign == mark, op) if name is None else name.when(sign == mark, op)
    amount = F.translate(_group(text, COMPARISON_PATTERN, 3), "$", "")
    return F.struct(
        F.upper(_group(text, ID_PATTERN, 1)).alias("mentioned_id"),
        _mentioned(text, REGIONS).alias("regions"),
        _mentioned(text, STATUSES).alias("statuses"),
        _mentioned(text, CATEGORIES).alias("categories"),
        _group(text, COMPARISON_PATTERN, 1).alias("compared_field"),
        name.alias("compared_op"),
        amount.try_cast("double").alias("compared_value"),
        _group(text, TOP_PATTERN, 1).try_cast("int").alias("top_n"),
    )
