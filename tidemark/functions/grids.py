"""Date grids."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import STEP_DAYS


def eval_dates(start: dt.date, end: dt.date, step: int = STEP_DAYS) -> Column:
    """Array column of evaluation dates, both ends inclusive."""
    if end < start:
        return F.array().cast("array<date>")
    return F.sequence(F.lit(start), F.lit(end), F.expr(f"INTERVAL {step} DAYS"))


def month_starts(start: dt.date | Column, end: dt.date | Column) -> Column:
    """Array column of the first of each month in [start, end], of fixed dates or of columns."""
    first = F.trunc(start, "month") if isinstance(start, Column) else F.lit(start.replace(day=1))
    return F.sequence(first, end if isinstance(end, Column) else F.lit(end), F.expr("INTERVAL 1 MONTH"))


def days_of(start: dt.date, end: dt.date) -> Column:
    """Array column of every day in [start, end]."""
    return F.sequence(F.lit(start), F.lit(end), F.expr("INTERVAL 1 DAY"))


def as_frame(spark: SparkSession, dates: Column, name: str = "t") -> DataFrame:
    return spark.range(1).select(F.explode(dates).alias(name))


def day_ceil(moment: Column) -> Column:
    """First day that begins at or after ``moment`` (date or timestamp)."""
    day = moment.cast("date")
    return F.when(day.cast("timestamp_ntz") == moment.cast("timestamp_ntz"), day).otherwise(F.date_add(day, 1))


def month_ceil(moment: Column) -> Column:
    """First month start at or after ``moment`` (date or timestamp)."""
    start = F.trunc(moment, "month")
    return F.when(start.cast("timestamp_ntz") == moment.cast("timestamp_ntz"), start).otherwise(F.add_months(start, 1))
