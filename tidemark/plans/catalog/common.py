"""Rounding shared by registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(col: str | Column, name: str | None = None) -> Column:
    """Six places, and no negative zero, so that engines agree."""
    value = F.col(col) if isinstance(col, str) else col
    out = F.round(value.cast("double"), 6) + F.lit(0.0)
    return out.alias(name or col) if (name or isinstance(col, str)) else out


def big(col: str | Column, name: str | None = None) -> Column:
    value = F.col(col) if isinstance(col, str) else col
    return value.cast("bigint").alias(name or col)


def text_list(col: Column, name: str) -> Column:
    """An array as one comparable string."""
    return F.array_join(col, ",").alias(name)


def pick(df: DataFrame, *cols: str | Column) -> DataFrame:
    return df.select(*cols)
