"""Landed series rows to signals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.coerce import dirty_number, period_date, plain_number, published_after

SIGNAL_SCHEMA = T.StructType(
    [
        T.StructField("segment", T.StringType(), False),
        T.StructField("subsegment", T.StringType()),
        T.StructField("signal_name", T.StringType(), False),
        T.StructField("value_num", T.DoubleType()),
        T.StructField("value_text", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("geography", T.StringType()),
        T.StructField("source", T.StringType(), False),
        T.StructField("source_id", T.StringType()),
        T.StructField("observed_at", T.DateType(), False),
        T.StructField("released_at", T.TimestampNTZType()),
        T.StructField("ingested_at", T.TimestampNTZType()),
        T.StructField("tickers", T.ArrayType(T.StringType())),
    ]
)


def as_signals(df: DataFrame, **cols: Column | str | None) -> DataFrame:
    """Project to the signal schema; a plain string is a literal, a missing column null."""
    out = []
    for field in SIGNAL_SCHEMA.fields:
        value = cols.get(field.name)
        expr = value if isinstance(value, Column) else F.lit(value)
        out.append(expr.cast(field.dataType).alias(field.name))
    return df.select(*out)


def read_landed(spark, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Landed JSON with an explicit schema: (good rows, rows that did not fit it)."""
    rescue = T.StructField("_corrupt", T.StringType())
    rows = (
        spark.read.schema(T.StructType([*schema.fields, rescue]))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    return rows.filter(F.col("_corrupt").isNull()).drop("_corrupt"), rows.filter(F.col("_corrupt").isNotNull())


def normalize_series(rows: DataFrame, spec: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Series rows with the value column the spec names.

    ``rows`` has series_id, period and the candidate columns value, sales, generation as
    text; ``spec`` has series_id, segment, subsegment, signal_name, unit, geography,
    value_column.
    """
    value = (
        F.when(F.col("value_column") == "sales", F.col("sales"))
        .when(F.col("value_column") == "generation", F.col("generation"))
        .otherwise(F.col("value"))
    )
    joined = (
        rows.join(spec, "series_id")
        .withColumn("_v", dirty_number(value))
        .withColumn("_d", period_date(F.col("period"), "end"))
        .filter(F.col("_v").isNotNull() & F.col("_d").between(F.lit(start), F.lit(end)))
    )
    return as_signals(
        joined,
        segment=F.col("segment"),
        subsegment=F.col("subsegment"),
        signal_name=F.col("signal_name"),
        value_num=F.col("_v"),
        unit=F.col("unit"),
        geography=F.col("geography"),
        source="series",
        source_id=F.col("series_id"),
        observed_at=F.col("_d"),
    )


def fan_out_series(obs: DataFrame, spec: DataFrame, missing: str = ".") -> DataFrame:
    """Every observation once per target segment of its series.

    ``spec`` has series_id, signal_name, unit and an array of segments. Missing values
    are dropped, unreadable ones keep their text with a null number.
    """
    joined = (
        obs.filter(F.col("value").isNotNull() & (F.col("value") != missing))
        .join(spec, "series_id")
        .withColumn("segment", F.explode("segments"))
    )
    return as_signals(
        joined,
        segment=F.col("segment"),
        signal_name=F.col("signal_name"),
        value_num=plain_number(F.col("value")),
        value_text=F.col("value"),
        unit=F.col("unit"),
        geography="US",
        source="macro",
        source_id=F.col("series_id"),
        observed_at=F.col("date"),
    )


def trade_signals(obs: DataFrame, code_map: DataFrame) -> DataFrame:
    """S3: trade value by commodity code, several codes to one segment."""
    joined = (
        obs.join(code_map, "code")
        .withColumn("_v", plain_number(F.col("trade_value")))
        .withColumn("_d", period_date(F.col("period"), "start"))
        .filter(F.col("_v").isNotNull() & F.col("_d").isNotNull())
    )
    return as_signals(
        joined,
        segment=F.col("segment"),
        signal_name="trade_volume",
        value_num=F.col("_v"),
        value_text=F.col("trade_value"),
        unit="USD",
        geography="US",
        source="trade",
        source_id=F.concat_ws("_", "code", "period"),
        observed_at=F.col("_d"),
    )


def planned_rows(rows: DataFrame, release_year: int, release_month: int) -> DataFrame:
    """Planned capacity from a generator inventory, published with the release.

    A missing or impossible month falls back to the release month; rows without state,
    capacity or year are dropped.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    capacity = plain_number(text("capacity"))
    year = F.when(text("year").rlike(r"^[+-]?\d+$"), text("year").try_cast("int"))
    stated = F.when(text("month").rlike(r"^[+-]?\d+$"), text("month").try_cast("int"))
    month = F.when(stated.between(1, 12), stated).otherwise(release_month)
    ok_year = F.when(year.between(1, 9999), year)
    observed = F.make_date(ok_year, month, F.lit(1))
    prime = F.when(text("prime_mover") == "", "UNK").otherwise(text("prime_mover"))
    kept = rows.filter((F.length(text("state")) > 0) & capacity.isNotNull() & ok_year.isNotNull())
    return as_signals(
        kept,
        segment="power_generation_oem",
        subsegment=F.concat_ws(":", F.lit("planned"), prime, F.nullif(text("energy_source"), F.lit(""))),
        signal_name="planned_capacity_mw",
        value_num=capacity,
        value_text=F.nullif(text("status"), F.lit("")),
        unit="MW",
        geography=F.concat(F.lit("US-"), text("state")),
        source="eia_860m",
        source_id=F.concat_ws(":", F.lit("planned"), text("entity_id"), text("plant_id"), text("generator_id")),
        observed_at=observed,
        released_at=F.lit(dt.datetime(release_year, release_month, 1)),
    )


def read_planned(spark, path: str) -> DataFrame:
    """The inventory tab landed as CSV, every column as text.

    Title and header rows above the data, in whichever split they fall, have no numeric
    entity id and are left out.
    """
    names = "entity_id plant_id generator_id state capacity year month prime_mover energy_source status".split()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).option("header", "false").csv(path)
    return rows.filter(F.col("entity_id").rlike(r"^\s*\d+\s*$"))


def released_signals(signals: DataFrame, lag_months: int) -> DataFrame:
    """X11 applied: model the publication date from the period."""
    return signals.withColumn(
        "released_at", published_after(F.col("observed_at"), lag_months).cast("timestamp_ntz")
    )
