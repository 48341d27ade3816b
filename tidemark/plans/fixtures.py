"""Domain views over the generic test tables.

The views give every operator input with the domain's shape: segments are part brands,
tickers are suppliers, regions come from the supplier's nation, signals are monthly
measures of shipped lines. Money and quantities are summed exactly (as hundredths
or decimals), so that results do not depend on the order of rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.constants import PROFILES

GRID_START, GRID_END = dt.date(1996, 1, 1), dt.date(2001, 12, 1)
BACKTEST_START, BACKTEST_END = dt.date(1998, 1, 15), dt.date(2000, 12, 31)
FORWARD_DAYS = 90

# Measure of a (segment, month) behind each signal, its publication lag and source.
SIGNAL_SPECS = [
    ("industrial_production", "units", 1, "macro"),
    ("capacity_utilization", "units / n_lines * 3.2D", 1, "macro"),
    ("ppi_transformers", "revenue / units / 10D", 1, "macro"),
    ("ppi_semis", "revenue / units", 1, "macro"),
    ("book_to_bill_ratio", "disc / n_lines * 22D", 1, "ratio_page"),
    ("trade_volume", "revenue", 2, "trade"),
    ("lead_time_mentions", "big", 0, "filings"),
    ("shortage_mentions", "ret", 0, "filings"),
    ("capacity_expansion_mentions", "opened", 0, "filings"),
    ("capacity_mw", "units * 3D", 3, "capacity"),
    ("hyperscaler_capex", "revenue / 1000000D", 2, "ledger"),
]


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its footer is read for the schema only once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def money(col: str) -> Column:
    return F.col(col).cast("decimal(18,2)")


def cents(col: str) -> Column:
    """Hundredths as a long: exact in any order, and summed by the hash aggregate in place."""
    return F.floor(F.col(col) * 100 + 0.5)


def seg_no(segment: Column) -> Column:
    return F.regexp_extract(segment, r"(\d+)$", 1).cast("int")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, seg_no, profile): one row per brand."""
    names = F.array(*[F.lit(p) for p in PROFILES])
    no = seg_no(F.col("segment"))
    return (
        table(spark, sf_dir, "part")
        .select(F.col("p_brand").alias("segment"))
        .distinct()
        .select("segment", no.alias("seg_no"), F.element_at(names, no % len(PROFILES) + 1).alias("profile"))
    )


def supplier_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, nation, region, s_name, s_acctbal)."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", "s_name", "s_acctbal", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    )


MEASURES = ("units", "revenue", "disc", "n_lines", "big", "ret", "opened")
HUNDREDTHS = ("units", "revenue", "disc")


def _whole(measure: str) -> Column:
    """A summed measure in whole units."""
    total = F.sum(measure)
    return (total / 100.0 if measure in HUNDREDTHS else total.cast("double")).alias(measure)


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, region, month) with all measures.

    Lines meet their part and supplier first. While those fit a broadcast the lines are
    never shuffled; beyond that Spark sort-merges and splits a hot part or supplier by
    itself. Either way partial sums per (segment, region, month) form before the shuffle.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("segment"))
    geo = supplier_geo(spark, sf_dir).select("s_suppkey", "region")
    flag = lambda cond: F.sum(cond.cast("long"))
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(geo, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("segment", "region", F.trunc("l_shipdate", "month").alias("month"))
        .agg(
            F.sum(cents("l_quantity")).alias("units"),
            F.sum(cents("l_extendedprice")).alias("revenue"),
            F.sum(cents("l_discount")).alias("disc"),
            F.count(F.lit(1)).alias("n_lines"),
            flag(F.col("l_quantity") >= 46).alias("big"),
            flag(F.col("l_returnflag") == "R").alias("ret"),
            flag(F.col("l_linestatus") == "O").alias("opened"),
        )
    )


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, month) with all measures as doubles."""
    return (
        cube(spark, sf_dir)
        .groupBy("segment", "month")
        .agg(*[_whole(m) for m in MEASURES])
    )


def _spec(name: str, value: str, lag: int, source: str, shift: int = 0, silent: bool = False) -> str:
    return (
        f"named_struct('name', '{name}', 'v', CAST({value} AS DOUBLE), 'lag', {lag}, 'source', '{source}', "
        f"'shift', {shift}, 'may_be_silent', {str(silent).lower()})"
    )


def _specs(*items: str) -> Column:
    return F.expr("array(" + ", ".join(items) + ")")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with three clocks, including re-emitted plans and grid pairs per region.

    One pass: national months, regional months and regional years come from one grouping
    over the shipped lines, and each group then emits its signals.
    """
    sums = [_whole(m) for m in MEASURES]
    grouped = cube(spark, sf_dir).withColumn("year", F.trunc("month", "year"))
    c = F.col
    levels = grouped.groupingSets(
        [[c("segment"), c("month")], [c("segment"), c("region"), c("month")], [c("segment"), c("region"), c("year")]],
        "segment", "region", "month", "year",
    ).agg(*sums)
    national = _specs(
        *[_spec(n, v, lag, src, silent=True) for n, v, lag, src in SIGNAL_SPECS],
        _spec("planned_capacity_mw", "units / 4D", 1, "eia_860m", shift=12),
        _spec("planned_capacity_mw", "units / 4D * 1.1D", 3, "eia_860m", shift=12),
    )
    peak = _specs(_spec("iso_peak_load_mw", "units", 1, "grid"))
    capacity = _specs(_spec("iso_capacity_mw", "units / 8D", 3, "grid"))
    emitted = F.when(c("region").isNull(), national).when(c("year").isNull(), peak).otherwise(capacity)
    base = F.coalesce("month", "year")
    no = seg_no(c("segment"))
    due = F.add_months("base", c("s.lag"))
    silent = c("s.may_be_silent") & ((F.year("base") * 12 + F.month("base") + no) % 7 == 0)
    return levels.withColumn("base", base).withColumn("s", F.explode(emitted)).select(
        "segment",
        c("s.name").alias("signal_name"),
        c("s.v").alias("value_num"),
        F.coalesce("region", F.lit("")).alias("geography"),
        c("s.source").alias("source"),
        F.concat_ws(":", c("s.name"), "segment", F.coalesce("region", F.lit("")), F.date_format("base", "yyyy-MM")).alias("source_id"),
        F.add_months("base", c("s.shift")).alias("observed_at"),
        F.when(~silent, due).cast("timestamp_ntz").alias("released_at"),
        F.date_add(due, no % 5).cast("timestamp_ntz").alias("ingested_at"),
    )


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, sub_score, seed_value): curated constants, here a function of the segment number."""
    no = F.col("seg_no")
    entries = F.array(
        F.struct(F.lit("lead_time_growth").alias("sub_score"), ((no * 37) % 100 / 100.0).alias("seed_value")),
        F.struct(F.lit("geo_concentration").alias("sub_score"), (0.2 + (no % 5) / 10.0).alias("seed_value")),
        F.struct(F.lit("regulatory_friction").alias("sub_score"), ((no * 53) % 100 / 100.0).alias("seed_value")),
        F.struct(F.lit("demand_signal").alias("sub_score"), ((no * 71) % 100 / 100.0).alias("seed_value")),
    )
    return segments(spark, sf_dir).select("segment", F.explode(entries).alias("e")).select("segment", "e.*")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, exchange, name, segment, subsegment, exposure, mcap, region, row_no).

    Exposure is the supplier's revenue in the brand against its best brand; brands below
    35 % are not listed, so that tickers differ in the segments they belong to.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("segment"))
    sold = (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey", "segment")
        .agg((F.sum(cents("l_extendedprice")) / 100.0).alias("revenue"))
    )
    best = sold.groupBy("l_suppkey").agg(F.max("revenue").alias("best"))
    return (
        sold.join(best, "l_suppkey")
        .join(supplier_geo(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_suppkey").cast("string").alias("ticker"),
            F.col("nation").alias("exchange"),
            F.col("s_name").alias("name"),
            "segment",
            F.concat(F.lit("sub"), (F.col("l_suppkey") % 3).cast("string")).alias("subsegment"),
            (F.floor(F.col("revenue") * 10000.0 / F.col("best")) / 10000.0).alias("exposure"),
            (F.abs(money("s_acctbal")) * 1000000).cast("double").alias("mcap"),
            "region",
            (F.col("l_suppkey") * 100 + seg_no(F.col("segment"))).alias("row_no"),
        )
        .filter(F.col("exposure") >= 0.35)
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, close): mean unit price of a supplier's lines, in weekly bars."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.trunc("l_shipdate", "week").alias("date"))
        .agg((F.sum(cents("l_extendedprice")) / 100.0).alias("r"), (F.sum(cents("l_quantity")) / 100.0).alias("q"))
        .select(F.col("l_suppkey").cast("string").alias("ticker"), "date", (F.floor(F.col("r") * 10000.0 / F.col("q")) / 10000.0).alias("close"))
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, ticker, quarter, value): order value by customer nation and quarter."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", F.trunc("o_orderdate", "quarter").alias("q")).agg(
        F.sum(money("o_totalprice")).alias("v")
    )
    return (
        orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment", "c_nationkey", "q")
        .agg(F.sum("v").alias("v"))
        .select(
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").cast("string").alias("ticker"),
            F.concat(F.year("q"), F.lit("-Q"), F.quarter("q")).alias("quarter"),
            "v",
        )
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, insider, day, accession): purchase events."""
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") == "purchase")
        .select(
            F.get_json_object("props", "$.k").alias("ticker"),
            F.col("user_id").alias("insider"),
            F.col("ts").cast("date").alias("day"),
            F.lpad(F.col("event_id").cast("string"), 12, "0").alias("accession"),
        )
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, form, ticker, filed, text): documents dressed as filings with section headings."""
    docs = table(spark, sf_dir, "documents")
    forms = F.array(*[F.lit(f) for f in ("10-K", "10-Q", "8-K", "20-F", "S-1")])
    head = F.expr("substring(text, 1, cast(length(text) / 2 as int))")
    tail = F.expr("substring(text, cast(length(text) / 2 as int) + 1)")
    form = F.element_at(forms, (F.col("doc_id") % 5).cast("int") + 1)
    layout = (
        F.when(F.col("doc_id") % 7 == 6, F.col("text"))
        .when(form == "10-Q", F.concat(F.lit("Intro. Item 1A. "), head, F.lit(" ITEM 2 - "), tail, F.lit(" Item 3. Rest.")))
        .otherwise(
            F.concat(F.lit("Intro. Item 1A: "), head, F.lit(" Item 1B. None. Item 7. "), tail, F.lit(" item 7A. Risk. Item 8. Data."))
        )
    )
    return docs.select(
        "doc_id",
        form.alias("form"),
        F.regexp_extract("source", r"(\d+)$", 1).alias("ticker"),
        F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("doc_id") % 365).cast("int")).alias("filed"),
        layout.alias("text"),
    )


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, commodity, role_kind): supplier -> brand -> customer nation -> region.

    Lines meet their part before supplier, brand and type are made distinct: pairs of a supplier and a part hardly
    repeat, so a distinct over them would hold nearly all lines. Names are put together last.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    line = table(spark, sf_dir, "lineitem")
    supplies = (
        line.select("l_suppkey", "l_partkey")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select("l_suppkey", "p_brand", "p_type").distinct()
        .select(
            F.concat(F.lit("S:"), F.col("l_suppkey").cast("string")).alias("src"),
            F.concat(F.lit("B:"), F.col("p_brand")).alias("dst"),
            F.col("p_type").alias("commodity"),
            F.lit("suppliesCommodity").alias("role_kind"),
        )
    )
    buyer = (
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_nationkey")
    )
    sells = (
        line.select("l_orderkey", "l_partkey")
        .join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .select("l_orderkey", "p_brand").distinct()
        .join(buyer, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("p_brand", "c_nationkey").distinct()
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("B:"), F.col("p_brand")).alias("src"),
            F.concat(F.lit("N:"), F.col("n_name")).alias("dst"),
            F.lit(None).cast("string").alias("commodity"),
            F.lit("supplies").alias("role_kind"),
        )
    )
    located = (
        table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("N:"), F.col("n_name")).alias("src"),
            F.concat(F.lit("R:"), F.col("r_name")).alias("dst"),
            F.lit(None).cast("string").alias("commodity"),
            F.lit("supplies").alias("role_kind"),
        )
    )
    return supplies.unionByName(sells).unionByName(located)


def graph_nodes(spark: SparkSession, sf_dir: str, uni: DataFrame | None = None) -> DataFrame:
    """(id, label, sector, companies) for every node of the supply graph; ``uni`` is a stored universe."""
    sup = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("id"),
        F.col("s_name").alias("label"),
        F.lit("SupplierSector").alias("sector"),
        F.array("s_name").alias("companies"),
    )
    brands = (universe(spark, sf_dir) if uni is None else uni).groupBy("segment").agg(
        F.array_sort(F.collect_set(F.when(F.col("exposure") >= 0.9, F.col("name")))).alias("companies")
    ).select(
        F.concat(F.lit("B:"), F.col("segment")).alias("id"),
        F.col("segment").alias("label"),
        F.lit("BrandSector").alias("sector"),
        "companies",
    )
    empty = F.array().cast("array<string>")
    nations = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("N:"), F.col("n_name")).alias("id"), F.col("n_name").alias("label"),
        F.lit("NationSector").alias("sector"), empty.alias("companies"),
    )
    regions = table(spark, sf_dir, "region").select(
        F.concat(F.lit("R:"), F.col("r_name")).alias("id"), F.col("r_name").alias("label"),
        F.lit("RegionSector").alias("sector"), empty.alias("companies"),
    )
    return sup.unionByName(brands).unionByName(nations).unionByName(regions)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, segment, side): research notes, here one per user turn of a conversation."""
    return (
        table(spark, sf_dir, "conversations")
        .filter(F.col("role") == "user")
        .select(
            (F.col("conv_id") % 97).cast("string").alias("ticker"),
            F.concat(F.lit("Brand#"), (F.col("conv_id") % 25 + 1).cast("string")).alias("segment"),
            F.when(F.col("turn") % 2 == 0, "long").otherwise("short").alias("side"),
        )
    )
