"""Region assignment and concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import HHI_FLOOR
from tidemark.functions.labels import region_of


def assign_region(universe: DataFrame, overrides: DataFrame, exchange_region: DataFrame | None = None) -> DataFrame:
    """Region by override on ticker, then on name, then by exchange.

    ``overrides`` has (key, region, parent) with unique keys. Rows with a parent are
    grouped under it, and take the parent's own override region if it has one.
    ``exchange_region`` (exchange, region) replaces the built-in map.
    """

    def side(prefix: str) -> DataFrame:
        return overrides.select(
            F.col("key").alias(f"{prefix}_key"),
            F.col("region").alias(f"{prefix}_region"),
            F.col("parent").alias(f"{prefix}_parent"),
        )

    out = universe.join(side("t"), F.col("ticker") == F.col("t_key"), "left").join(
        side("n"), F.col("name") == F.col("n_key"), "left"
    )
    by_ticker = F.col("t_key").isNotNull()
    out = out.withColumn(
        "company_key",
        F.coalesce(F.when(by_ticker, F.col("t_parent")).otherwise(F.col("n_parent")), F.nullif("ticker", F.lit("")), "name"),
    )
    out = out.join(side("p"), F.col("company_key") == F.col("p_key"), "left")
    if exchange_region is None:
        home = region_of(F.col("exchange"))
    else:
        out = out.join(exchange_region.select("exchange", F.col("region").alias("x_region")), "exchange", "left")
        home = F.col("x_region")
    own = F.when(by_ticker, F.col("t_region")).when(F.col("n_key").isNotNull(), F.col("n_region")).otherwise(home)
    return (
        out.withColumn("region", F.when(own.isNotNull(), F.coalesce("p_region", own)))
        .select(*universe.columns, "company_key", "region")
    )


def hhi(df: DataFrame, group: list[str], region: str, weight: str, floor: float = HHI_FLOOR) -> DataFrame:
    """A4: concentration over regions that hold at least ``floor`` of the weight.

    Only one row per (group, region) passes the first aggregation, so the share
    windows are as small as the region list.
    """
    totals = (
        df.filter(F.col(region).isNotNull())
        .groupBy(*group, region)
        .agg(F.sum(weight).cast("double").alias("_w"))
    )
    whole = Window.partitionBy(*group)
    return (
        totals.withColumn("_all", F.sum("_w").over(whole))
        .filter((F.col("_all") > 0) & (F.col("_w") / F.col("_all") >= floor))
        .groupBy(*group)
        .agg((F.sum(F.col("_w") * F.col("_w")) / F.pow(F.sum("_w"), F.lit(2.0))).alias("hhi"))
    )


def exposure_hhi(universe: DataFrame, group: list[str] = ["segment"]) -> DataFrame:  # noqa: B006
    """A4 on a universe: weight is exposure times market cap, both positive."""
    held = universe.filter((F.col("exposure") > 0) & (F.col("mcap") > 0))
    return hhi(held.withColumn("_weight", F.col("exposure") * F.col("mcap")), group, "region", "_weight")


def hhi_counts(roles: DataFrame, group: list[str], region: str) -> DataFrame:
    """A5: the same index over role counts."""
    return hhi(roles.withColumn("_one", F.lit(1.0)), group, region, "_one")


def regions_per_role(roles: DataFrame, cls: str | None = None) -> DataFrame:
    """Distinct regions each role of a class operates in."""
    if cls is not None:
        roles = roles.filter(F.col("class") == cls)
    return roles.groupBy("role").agg(F.countDistinct("region").alias("n"))
