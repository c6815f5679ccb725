"""Mixed date layouts to ISO dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import NULL_WORDS_LOWER, strip

# The layouts read, and those whose presence is counted.
ISO = r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"
YEAR_FIRST = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})([ T].*)?$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
SHORT_YEAR_20 = r"^(?<dm>\d{1,2}[/.-]\d{1,2}[/.-])(?<y>[0-5]\d|6[0-8])$"
SHORT_YEAR_19 = r"^(?<dm>\d{1,2}[/.-]\d{1,2}[/.-])(?<y>\d{2})$"
MONTH_FIRST = r"^(0?[1-9]|1[0-2])[/.-](\d{1,2})[/.-](\d{4})([ T].*)?$"
DAY_FIRST = r"^(\d{1,2})[/.-](0?[1-9]|1[0-2])[/.-](\d{4})([ T].*)?$"
MONTH_NAME_FIRST = r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})$"
DAY_THEN_NAME = r"^(\d{1,2})[ -]([A-Za-z]{3})[a-z]*\.?,?[ -](\d{4})$"
EPOCH = r"^\d{10,13}$"
DASH_LAYOUT = r"^\d{4}-\d{1,2}-\d{1,2}"
SLASH_LAYOUT = r"^\d{1,2}/\d{1,2}/\d{2,4}"
DAY_OVER_12 = r"^(1[3-9]|[2-9]\d)/\d{1,2}/\d{2,4}"


def to_iso_date(c: Column, day_first: bool = False) -> Column:
    """A date, or null where no layout fits.

    ``day_first`` decides how ``03/02/2024`` is read. A part over 12 can only
    be the day, so the other order is taken where the first cannot be. 10
    digits are epoch seconds, 11 to 13 are milliseconds. No layout depends on
    the clock. Each layout is a test and a rewrite into year-month-day; text
    without a digit passes none of them.
    """
    s = strip(c.cast("string"))
    month_first = (MONTH_FIRST, "$3-$1-$2$4")
    day_order = (DAY_FIRST, "$3-$2-$1$4")
    orders = (day_order, month_first) if day_first else (month_first, day_order)

    def date(text):
        return text.try_cast("timestamp_ntz").cast("date")

    def rewritten(text, pattern, replacement):
        return F.regexp_replace(text, pattern, replacement)

    def short_year(pattern, century):
        full = rewritten(s, pattern, "${dm}" + century + "${y}")
        return F.coalesce(*[
            F.when(full.rlike(p), date(rewritten(full, p, r))) for p, r in orders
        ])

    def named(pattern, replacement):
        text = F.initcap(rewritten(s, pattern, replacement))
        return F.try_to_timestamp(text, F.lit("yyyy MMM d")).cast("date")

    per_day = F.when(F.length(s) == 10, 86_400).otherwise(86_400_000)
    days = F.floor(s.try_cast("bigint") / per_day).cast("int")
    found = F.when(~s.rlike(r"\d"), F.lit(None).cast("date")).when(s.rlike(ISO), date(s))
    for pattern, replacement in (*orders, (YEAR_FIRST, "$1-$2-$3$4"), (COMPACT, "$1-$2-$3")):
        found = found.when(s.rlike(pattern), date(rewritten(s, pattern, replacement)))
    return (
        found.when(s.rlike(EPOCH), F.date_add(F.lit("1970-01-01").cast("date"), days))
        .when(s.rlike(SHORT_YEAR_20), short_year(SHORT_YEAR_20, "20"))
        .when(s.rlike(SHORT_YEAR_19), short_year(SHORT_YEAR_19, "19"))
        .when(s.rlike(MONTH_NAME_FIRST), named(MONTH_NAME_FIRST, "$3 $1 $2"))
        .when(s.rlike(DAY_THEN_NAME), named(DAY_THEN_NAME, "$3 $2 $1"))
    )


def parse_dates(c: Column, day_first: bool = False, output_format: str = "yyyy-MM-dd") -> Column:
    """ISO text; null words become null and text that is no date is kept."""
    s = strip(c.cast("string"))
    found = to_iso_date(c, day_first)
    text = found.cast("string") if output_format == "yyyy-MM-dd" else F.date_format(found, output_format)
    return F.when(~F.lower(s).isin(*NULL_WORDS_LOWER), F.coalesce(text, s))


def first_part_over_12(c: Column) -> Column:
    """Whether a slash date can only be day-first; false for everything else."""
    return F.coalesce(strip(c.cast("string")).rlike(DAY_OVER_12), F.lit(False))
