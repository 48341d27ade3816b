"""Column functions that turn dirty source text into numbers and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_MARKERS = ("", "NA", "--", "NULL")
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def plain_number(text: Column) -> Column:
    """Double when the trimmed text is an ordinary number, else null."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(PLAIN_NUMBER), trimmed.try_cast("double"))


def dirty_number(text: Column) -> Column:
    """Missing markers and censored values (``<0.001``) become null."""
    trimmed = F.trim(text.cast("string"))
    missing = F.upper(trimmed).isin(*MISSING_MARKERS) | trimmed.startswith("<")
    return F.when(~missing, plain_number(trimmed))


def money(text: Column) -> Column:
    """``$1,234.50`` -> 1234.5; blank or unreadable -> null."""
    cleaned = F.regexp_replace(F.trim(text), "[,$]", "")
    return F.when(cleaned.rlike(PLAIN_NUMBER), cleaned.try_cast("decimal(38,10)").cast("double"))


def period_date(period: Column, year_anchor: str = "end") -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD text (or number) to a date.

    ``year_anchor`` keeps the source's own rule for bare years: ``end`` is
    31 December, ``start`` is 1 January.
    """
    text = F.trim(period.cast("string"))
    suffix = {"end": "-12-31", "start": "-01-01"}[year_anchor]
    iso = (
        F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit(suffix)))
        .when(text.rlike(r"^\d{4}-\d{1,2}$"), F.concat(text, F.lit("-01")))
        .when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text)
    )
    return iso.try_cast("date")


def month_name_period(text: Column) -> Column:
    """``Mar 2024`` / ``2024-3`` anywhere in a cell -> ``2024-03``, else null."""
    numeric = r"(\d{4})[-/](\d{1,2})"
    named = r"(?i)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\b\s+(\d{4})"
    names = F.lit("janfebmaraprmayjunjulaugsepoctnovdec")
    month_of_name = (F.instr(names, F.lower(F.regexp_extract(text, named, 1))) + 2) / 3
    return (
        F.when(
            text.rlike(numeric),
            F.concat_ws("-", F.regexp_extract(text, numeric, 1), F.lpad(F.regexp_extract(text, numeric, 2), 2, "0")),
        ).when(
            text.rlike(named),
            F.concat_ws(
                "-", F.regexp_extract(text, named, 2), F.lpad(month_of_name.cast("int").cast("string"), 2, "0")
            ),
        )
    )


def published_after(observed: Column, months: int) -> Column:
    """X11: modeled publication date of an observation month."""
    return F.add_months(F.trunc(observed, "month"), months)
