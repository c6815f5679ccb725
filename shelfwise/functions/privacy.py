"""Masking of personal data, and phrases that try to override instructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.text import name_col

# Fixed values.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
CARD = r"\b(?:\d[ -]*?){13,16}\b"
PHONE = r"(\+?\d{1,3}[-.\s]?)?(\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}"
MASKS = ((EMAIL, "[EMAIL_MASKED]"), (CARD, "[CARD_MASKED]"), (PHONE, "[PHONE_MASKED]"))
REDACTED = "[REDACTED]"
SENSITIVE_COLUMNS = (
    "email", "phone", "phone_number", "ssn", "credit_card", "password", "address",
)
INJECTION_PATTERNS = {
    "ignore_previous": r"ignore\s+(all\s+)?previous\s+instructions",
    "system_prompt": r"system\s+prompt",
    "print_secret": r"print\s+(secret|password|api[-_]?key)",
    "developer_mode": r"you\s+are\s+now\s+in\s+developer\s+mode",
    "bypass_rules": r"bypass\s+all\s+rules",
}


def mask_pii(c: Column, strict: bool = False) -> Column:
    """E-mails, then cards, then phone numbers.

    Each pattern runs only over text that can hold a match: an at sign, a
    digit, three and four digits in a row. ``strict`` asks for a phone number
    to stand alone, so that seven digits inside a longer number or word are
    left.
    """
    needs = (c.contains("@"), c.rlike(r"(?U)\d"), c.rlike(r"(?U)\d{3}[-.\s]?\d{4}"))
    masked = c
    for (pattern, mask), needed in zip(MASKS, needs):
        if strict and pattern == PHONE:
            pattern = rf"(?<![\w]){PHONE}(?![\w])"
        replaced = F.regexp_replace(masked, "(?U)" + pattern, mask.replace("[", r"\["))
        masked = F.when(needed, replaced).otherwise(masked)
    return masked


def mask_table(df: DataFrame) -> DataFrame:
    """Sensitive columns redacted whole, other text columns masked."""
    columns = []
    for field in df.schema.fields:
        c = name_col(field.name)
        if field.name.lower() in SENSITIVE_COLUMNS:
            c = F.lit(REDACTED)
        elif isinstance(field.dataType, T.StringType):
            c = mask_pii(c)
        columns.append(c.alias(field.name))
    return df.select(*columns)


def injection_flag(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike("(?iU)" + INJECTION_PATTERNS[pattern]), F.lit(False))


def has_injection(c: Column) -> Column:
    found = F.lit(False)
    for pattern in INJECTION_PATTERNS:
        found = found | injection_flag(c, pattern)
    return found
