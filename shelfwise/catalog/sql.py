"""SQL expressions of the column rules, for the SQL side of the checks."""

from __future__ import annotations

from shelfwise.functions.numbers import NUMBER_PATTERN

BOOLEANS = "('true','false','0','1','yes','no','t','f','y','n')"


def number(c: str, kind: str = "DECIMAL(30,6)") -> str:
    s = f"trim(CAST({c} AS VARCHAR))"
    body = (
        f"CASE WHEN {s} LIKE '(%)' THEN substr({s}, 2, length({s}) - 2) "
        f"WHEN {s} LIKE '%-' THEN left({s}, length({s}) - 1) ELSE {s} END"
    )
    bare = f"regexp_replace({body}, '[$,€£¥% ]', '', 'g')"
    sign = f"CASE WHEN {s} LIKE '(%)' OR {s} LIKE '%-' THEN -1 ELSE 1 END"
    return (
        f"CASE WHEN regexp_matches({bare}, '{NUMBER_PATTERN}') "
        f"THEN CAST({sign} * TRY_CAST({bare} AS {kind}) AS {kind}) END"
    )


def iso_date(c: str, day_first: bool = False) -> str:
    orders = ("%d/%m/%Y", "%m/%d/%Y") if day_first else ("%m/%d/%Y", "%d/%m/%Y")
    tried = ", ".join(f"try_strptime({c}, '{f}')" for f in ("%Y-%m-%d", *orders))
    return f"strftime(coalesce({tried}), '%Y-%m-%d')"


def title(c: str) -> str:
    return (
        f"array_to_string(list_transform(string_split_regex(trim({c}), '\\s+'), lambda w: "
        "CASE WHEN upper(w) = w AND length(w) <= 4 THEN w "
        "ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ')"
    )


def initcap(c: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({c}, ' '), lambda w: "
        "upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
    )


def round2(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,6)), 2) AS DOUBLE)"


def ratio2(numerator: str, denominator: str, scale: str = "1.0") -> str:
    share = f"CAST({numerator} AS DOUBLE) / CAST({denominator} AS DOUBLE) * CAST({scale} AS DOUBLE)"
    return f"CAST(round(CAST({share} AS DECIMAL(28,6)), 2) AS DECIMAL(18,2))"


def per_column(columns, row) -> str:
    return " UNION ALL ".join(row(c) for c in columns)
