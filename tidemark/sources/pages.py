"""Ratio tables inside HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import RATIO_HIGH, RATIO_LOW
from tidemark.functions.coerce import month_name_period
from tidemark.sources.filings import text_of_html

_TABLE = r"(?is)<table\b[^>]*>(.*?)</table\s*>"
_ROW = r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"
_CELL = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"
_HEAD = r"(?is)<th\b[^>]*>(.*?)</th\s*>"
_DECIMAL = r"(\d+\.\d+)"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def html_ratio_rows(
    pages: DataFrame, key: str = "page_id", html_col: str = "html", lo: float = RATIO_LOW, hi: float = RATIO_HIGH
) -> DataFrame:
    """(key, period, ratio) from table rows that hold a period and a ratio in range.

    The first table whose header speaks of a ratio and that yields rows is used; a page
    without one falls back to all its tables.
    """
    tables = pages.select(key, F.posexplode(_all(F.col(html_col), _TABLE)).alias("tab", "table"))
    headed = F.lower(F.array_join(F.transform(_all(F.col("table"), _HEAD), text_of_html), " ")).rlike("book-to-bill|ratio")
    rows = tables.withColumn("headed", headed).select(
        key, "tab", "headed", F.posexplode(_all(F.col("table"), _ROW)).alias("pos", "row")
    )
    cells = F.transform(_all(F.col("row"), _CELL), text_of_html)
    periods = F.filter(F.transform("cells", month_name_period), lambda p: p.isNotNull())
    numbers = F.transform(
        F.filter("cells", lambda c: month_name_period(c).isNull() & c.rlike(_DECIMAL)),
        lambda c: F.regexp_extract(c, _DECIMAL, 1).cast("double"),
    )
    in_range = F.filter(numbers, lambda v: (v >= lo) & (v <= hi))
    found = (
        rows.withColumn("cells", cells)
        .withColumn("period", F.get(periods, F.lit(0)))
        .withColumn("ratio", F.get(in_range, F.lit(0)))
        .withColumn("width", F.size("cells"))
        .filter(F.col("period").isNotNull() & F.col("ratio").isNotNull())
    )
    usable_head = F.when(F.col("headed") & (F.col("width") >= 2), F.col("tab"))
    found = found.withColumn("_best", F.min(usable_head).over(Window.partitionBy(key)))
    keep = F.col("_best").isNull() | ((F.col("tab") == F.col("_best")) & (F.col("width") >= 2))
    return found.filter(keep).select(key, "tab", "pos", "period", "ratio")
