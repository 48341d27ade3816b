"""Universe and capex ledger files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.coerce import plain_number
from tidemark.session import cut_lineage

COLUMNS = (
    "ticker exchange name segment subsegment exposure_pct market_cap_bucket mcap_usd currency_hedge notes row_no"
).split()
REQUIRED = ("ticker", "exchange", "segment", "exposure_pct")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Typed universe rows; unreadable numbers drop the row, blanks count as zero."""
    header = spark.read.option("header", "true").csv(path).columns
    absent = [c for c in REQUIRED if c not in header]
    if absent:
        raise ValueError(f"universe file lacks columns: {absent}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.schema(schema).option("header", "true").csv(path)
    for c in COLUMNS:
        if c not in header:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    return typed_universe(raw)


def typed_universe(raw: DataFrame) -> DataFrame:
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    number = lambda c: F.when(text(c) == "", 0.0).otherwise(plain_number(F.col(c)))
    return raw.select(
        text("ticker").alias("ticker"),
        text("exchange").alias("exchange"),
        text("name").alias("name"),
        text("segment").alias("segment"),
        F.nullif(text("subsegment"), F.lit("")).alias("subsegment"),
        (number("exposure_pct") / 100.0).alias("exposure"),
        number("mcap_usd").alias("mcap"),
        F.col("row_no").cast("long").alias("row_no"),
    ).filter(F.col("exposure").isNotNull() & F.col("mcap").isNotNull())


def drop_placeholders(universe: DataFrame) -> DataFrame:
    """leftover rows marked for removal, and rows without exposure."""
    sub = F.lower(F.coalesce("subsegment", F.lit("")))
    return universe.filter(~(sub.startswith("remove") | (sub == "placeholder") | (F.col("exposure") <= 0)))


LEDGER_ENTRY = "struct<ticker: string, quarter: string, ai_capex_usd_b: double, source: string>"


def read_ledger(files: DataFrame, json_col: str = "value") -> DataFrame:
    """(segment, ticker, quarter, value) from ledger JSON text, one document per row.

    Keys starting with ``_`` are comments. An alias takes the entries of the segment it
    names, over any number of hops: each round every pending alias jumps to what its target
    names, so the reach doubles. An alias of something unknown has no rows; a ring of aliases
    is an error.
    """
    # Comment values are not objects, so entries are read key by key.
    specs = files.select(F.explode(F.from_json(json_col, "map<string, string>")).alias("segment", "body")).filter(
        ~F.col("segment").startswith("_")
    )
    body = F.from_json("body", f"struct<entries: array<{LEDGER_ENTRY}>, entries_ref: string>")
    specs = specs.select("segment", body.alias("b")).select("segment", "b.entries", "b.entries_ref")
    specs = cut_lineage(specs)
    own = specs.filter(F.col("entries").isNotNull()).select(F.col("segment").alias("owner"), "entries")
    alias = F.col("entries").isNull() & F.col("entries_ref").isNotNull()
    names = cut_lineage(specs.filter(alias).select("segment", "entries_ref").distinct())
    for _ in range(max(names.count(), 1).bit_length() + 1):
        if names.join(names.select(F.col("segment").alias("entries_ref")), "entries_ref", "left_semi").isEmpty():
            break
        further = names.select(F.col("segment").alias("entries_ref"), F.col("entries_ref").alias("further"))
        hop = names.join(further, "entries_ref", "left")
        names = cut_lineage(hop.select("segment", F.coalesce("further", "entries_ref").alias("entries_ref")).distinct())
    else:
        raise ValueError("ledger aliases form a ring")
    owners = own.select("owner")
    resolved = owners.select(F.col("owner").alias("segment"), "owner").unionByName(
        names.join(owners, names["entries_ref"] == owners["owner"]).select("segment", "owner")
    )
    return (
        resolved.join(own, "owner")
        .select("segment", F.explode("entries").alias("e"))
        .select("segment", "e.ticker", "e.quarter", F.col("e.ai_capex_usd_b").alias("value"))
    )
