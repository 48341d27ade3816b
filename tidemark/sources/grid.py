"""Grid, capacity and environment sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import LB_PER_MWH_TO_G_PER_KWH
from tidemark.functions.coerce import dirty_number, period_date


def monthly_peak_total(
    daily: DataFrame, key: str = "respondent", type_col: str = "type", value_col: str = "value"
) -> DataFrame:
    """Monthly peak of demand rows and monthly total of generation rows."""
    kind = F.when(F.col(type_col).isin("D", "Demand"), "D").when(F.col(type_col).isin("NG", "Net generation"), "NG")
    rows = daily.select(
        F.col(key),
        F.trunc(period_date(F.col("period")), "month").alias("month"),
        kind.alias("kind"),
        dirty_number(F.col(value_col)).alias("v"),
    ).filter("month IS NOT NULL AND kind IS NOT NULL AND v IS NOT NULL")
    return rows.groupBy(key, "month").agg(
        F.max(F.when(F.col("kind") == "D", F.col("v"))).alias("peak"),
        F.sum(F.when(F.col("kind") == "NG", F.col("v"))).alias("total"),
    )


def coalesced_fields(daily: DataFrame) -> DataFrame:
    """The alternate field names one feed uses for region and row type."""

    def first_of(names: tuple[str, ...]) -> Column:
        present = [F.col(f"`{n}`") for n in names if n in daily.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    return daily.select(
        first_of(("respondent", "respondent-id", "respondent_id")).alias("respondent"),
        first_of(("type", "type-name", "type-description")).alias("type"),
        "period",
        "value",
    )


def fan_out_by_bridge(
    agg: DataFrame, bridge: DataFrame, region: str = "region", allowed: list[str] | None = None
) -> DataFrame:
    """Each region row once per segment that consumes the region."""
    if allowed is not None:
        agg = agg.filter(F.col(region).isin(*allowed))
    return agg.join(bridge, region)


def rollup_by_bridge(totals: DataFrame, bridge: DataFrame) -> DataFrame:
    """Region totals; a state may count in several regions; empty regions are dropped."""
    return (
        bridge.join(totals, "state")
        .groupBy("region")
        .agg(F.sum("total").alias("total"))
        .filter(F.col("total") > 0)
    )


def states_of(bridge: DataFrame, regions: list[str]) -> DataFrame:
    """Every state of the enabled regions once."""
    return bridge.filter(F.col("region").isin(*regions)).select("state").distinct()


def totals_with_grand(df: DataFrame, key: str, value: str, grand_label: str = "US") -> DataFrame:
    """Total per key and over all keys in one rollup."""
    return (
        df.rollup(key)
        .agg(F.sum(value).alias("total"), F.grouping_id().alias("_g"))
        .select(
            F.when(F.col("_g") == 1, grand_label)
            .otherwise(F.concat(F.lit(f"{grand_label}-"), F.col(key).cast("string")))
            .alias("geography"),
            "total",
        )
    )


def unpivot_units(df: DataFrame, key: str, value: str, factor: float = LB_PER_MWH_TO_G_PER_KWH) -> DataFrame:
    """One row per key in each of two units."""
    rate = F.col(value)
    units = F.array(
        F.struct(F.lit("co2_rate_lb_per_mwh").alias("signal_name"), F.lit("lb/MWh").alias("unit"), rate.alias("value")),
        F.struct(
            F.lit("co2_rate_g_per_kwh").alias("signal_name"),
            F.lit("gCO2/kWh").alias("unit"),
            (rate * F.lit(factor)).alias("value"),
        ),
    )
    return (
        df.filter(F.col(key).isNotNull() & rate.isNotNull())
        .select(key, F.explode(units).alias("u"))
        .select(key, "u.*")
    )


def broadcast_country(df: DataFrame, keys: DataFrame, order: list[str], iso: str = "USA") -> DataFrame:
    """The first matching country's score on every key.

    The score side is a single row by construction, so broadcasting it is safe.
    """
    match = (F.col("iso_a3") == iso) | F.col("name").contains("United States")
    first = (
        df.filter(match)
        .agg(F.min_by("water_stress", F.struct(*order)).alias("score"))
        .filter(F.col("score").isNotNull())
    )
    return keys.join(F.broadcast(first), F.lit(True))
