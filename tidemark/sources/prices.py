"""Price sources and the price table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.coerce import plain_number

_ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"


def _day(col: str):
    text = F.trim(F.col(col))
    return F.when(text.rlike(_ISO_DAY), text.try_cast("date"))


def parse_price_json(payloads: DataFrame, start: dt.date, end: dt.date, json_col: str = "payload") -> DataFrame:
    """Daily map of date -> fields to bars of the window."""
    parsed = F.from_json(json_col, "struct<`Time Series (Daily)`: map<string, map<string, string>>>")
    days = payloads.select("ticker", F.explode(parsed["Time Series (Daily)"]).alias("day", "fields"))
    return (
        days.select(
            "ticker",
            _day("day").alias("date"),
            plain_number(F.try_element_at("fields", F.lit("5. adjusted close"))).alias("close"),
        )
        .filter(F.col("date").between(F.lit(start), F.lit(end)) & F.col("close").isNotNull())
    )


def bars_from_wide(df: DataFrame) -> DataFrame:
    """Adjusted close if the history has one, close otherwise."""
    named = next((c for c in ("Adj Close", "Close") if c in df.columns), None)
    if named is None:
        return df.sparkSession.createDataFrame([], "ticker string, date date, close double")
    return df.select(
        "ticker", F.col("Date").cast("date").alias("date"), F.col(f"`{named}`").cast("double").alias("close")
    ).filter(F.col("close").isNotNull())


def read_prices(spark: SparkSession, path: str, start: dt.date, end: dt.date) -> DataFrame:
    """CSV bars of [start, end]; blank and unreadable rows are dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("ticker", "date", "close")])
    raw = spark.read.schema(schema).option("header", "true").csv(path)
    return (
        raw.select(
            F.trim("ticker").alias("ticker"), _day("date").alias("date"), plain_number(F.col("close")).alias("close")
        )
        .filter((F.length("ticker") > 0) & F.col("close").isNotNull())
        .filter(F.col("date").between(F.lit(start), F.lit(end)))
    )


def merge_prices(existing: DataFrame, new: DataFrame, round_to: int = 4) -> DataFrame:
    """New bars replace old ones of the same (ticker, date), the rest stays.

    A mergeable max_by keeps one copy per key, so repeated bars of a hot ticker are
    reduced before the shuffle.
    """
    both = existing.select("ticker", "date", "close", F.lit(0).alias("gen")).unionByName(
        new.select("ticker", "date", "close", F.lit(1).alias("gen"))
    )
    return both.groupBy("ticker", "date").agg(
        F.round(F.max_by("close", F.struct("gen", "close")), round_to).alias("close")
    )


def write_prices(prices: DataFrame, path: str) -> None:
    """Year partitions, sorted by ticker and date inside each file for pruning."""
    (
        prices.withColumn("year", F.year("date"))
        .hint("rebalance", "year")
        .sortWithinPartitions("year", "ticker", "date")
        .write.mode("overwrite")
        .partitionBy("year")
        .parquet(path)
    )
