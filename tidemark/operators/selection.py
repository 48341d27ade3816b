"""Screeners, baskets and watchlists, for all dates at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import (
    LONG_GUARD,
    MAX_SEGMENTS,
    MAX_TICKERS,
    MIN_BASKET_SCORE,
    MIN_EXPOSURE,
    MIN_MCAP_USD,
    SEGMENT_PROXIMITY,
)
from tidemark.operators.ranks import row_numbers


def eligible(universe: DataFrame, min_exposure: float = MIN_EXPOSURE, min_mcap: float = MIN_MCAP_USD) -> DataFrame:
    """exposed, large enough, named."""
    return universe.filter(
        (F.col("exposure") >= min_exposure)
        & (F.col("mcap") >= min_mcap)
        & (F.length("ticker") > 0)
        & (F.length("name") > 0)
    )


def listed_asof(members: DataFrame, prices: DataFrame, date_col: str) -> DataFrame:
    """keep members whose ticker already traded at the date.

    The first bar per ticker is a mergeable minimum, so no price history is joined.
    With no prices at all there is nothing to judge by; skip the gate then.
    """
    first_bar = prices.groupBy("ticker").agg(F.min("date").alias("_first_bar"))
    return members.join(first_bar, "ticker").filter(F.col("_first_bar") <= F.col(date_col)).drop("_first_bar")


def long_guard(scores: DataFrame) -> DataFrame:
    """F8: resolving and unscored regimes never enter a long list."""
    return scores.filter(~F.col("regime").isin(*LONG_GUARD))


def rank_key() -> Column:
    return F.col("b") * F.abs(F.col("b_prime"))


def screener(scores: DataFrame, side: str, horizon: str, by: list[str] | None = None) -> DataFrame:
    """Ranked candidates of one horizon, with no floor on B.

    ``by`` (for example ``["as_of"]``) ranks every date of a history in one pass, each date by many tasks.
    """
    rows = scores.filter(F.col("horizon") == horizon)
    if side == "long":
        rows = long_guard(rows).withColumn("rank_key", F.lit(None).cast("double"))
        order = [
            F.coalesce("b", F.lit(0.0)).desc(),
            F.coalesce("b_prime", F.lit(0.0)).desc(),
            F.col("segment").asc(),
        ]
    else:
        resolving = (F.col("regime") == "RESOLVING") & F.col("b").isNotNull() & F.col("b_prime").isNotNull()
        rows = rows.filter(resolving).withColumn("rank_key", rank_key())
        order = [F.col("rank_key").desc(), F.col("segment").asc()]
    if by is None:
        return rows.orderBy(*order)
    return row_numbers(rows, by, order)


def top_segments(scores: DataFrame, side: str, by: str = "t") -> DataFrame:
    """Up to two segments per date and side.

    The rank filter lets Spark keep only the leading rows of each task before the
    shuffle. The second long or short segment must be close to the first.
    """
    floor = scores.filter(F.col("b") >= MIN_BASKET_SCORE)
    if side == "long":
        rows, key = long_guard(floor), F.col("b")
        order = [F.col("b").desc(), F.coalesce("b_prime", F.lit(0.0)).desc(), F.col("segment")]
    elif side == "short":
        rows, key = floor.filter(F.col("regime") == "RESOLVING"), rank_key()
        order = [rank_key().desc(), F.col("b").desc(), F.col("segment")]
    elif side == "watchlist":
        rows, key = floor.filter(F.col("regime").isin("EMERGING", "PEAKED")), F.col("b")
        order = [F.col("b").desc(), F.col("segment")]
    else:
        raise ValueError(f"unknown side: {side!r}")
    picked = (
        rows.withColumn("_key", key)
        .withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
        .filter(F.col("rank") <= MAX_SEGMENTS)
    )
    if side != "watchlist":
        top = F.first("_key").over(Window.partitionBy(by).orderBy("rank"))
        picked = picked.withColumn("_top", top).filter(F.col("_key") >= F.col("_top") - SEGMENT_PROXIMITY).drop("_top")
    return picked.select(by, F.lit(side).alias("side"), "segment", "rank", "b")


def all_sides(scores: DataFrame, by: str = "t") -> DataFrame:
    long_, short, watch = (top_segments(scores, side, by) for side in ("long", "short", "watchlist"))
    return long_.unionByName(short).unionByName(watch)


def top_tickers(
    segments: DataFrame, universe: DataFrame, prices: DataFrame | None = None, n: int = MAX_TICKERS, by: str = "t"
) -> DataFrame:
    """The n most exposed eligible tickers per segment, each ticker once per basket.

    A ticker listed under several rows of a segment is one holding, at its best row.
    """
    members = (
        eligible(universe)
        .groupBy("ticker", "segment")
        .agg(F.max("exposure").alias("exposure"), F.max_by("mcap", "exposure").alias("mcap"))
    )
    held = segments.join(members, "segment")
    if prices is not None:
        held = listed_asof(held, prices, by)
    held = held.withColumn("contribution", F.col("exposure") * F.col("b"))
    in_segment = Window.partitionBy(by, "side", "segment").orderBy(F.col("contribution").desc(), "ticker")
    in_basket = Window.partitionBy(by, "side", "ticker").orderBy(F.col("contribution").desc(), "rank")
    return (
        held.withColumn("_rn", F.row_number().over(in_segment))
        .filter(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(in_basket))
        .filter(F.col("_rn") == 1)
        .select(by, "side", "segment", "ticker", "exposure", "mcap", "contribution")
    )


def entry_weights(entries: DataFrame, sector_neutral: bool = False, by: str = "t") -> DataFrame:
    """Equal weights, or equal per segment and equal inside it."""
    basket = Window.partitionBy(by, "side")
    if not sector_neutral:
        return entries.withColumn("weight", 1.0 / F.count(F.lit(1)).over(basket))
    n_segments = F.size(F.collect_set("segment").over(basket))
    inside = F.count(F.lit(1)).over(Window.partitionBy(by, "side", "segment"))
    return entries.withColumn("weight", 1.0 / n_segments / inside)


def primary_eta(universe: DataFrame, eta: DataFrame) -> DataFrame:
    """The resolution band of a ticker's most exposed segment that has one.

    ``universe`` carries ``row_no``; ``eta`` is (segment, eta, confidence).
    """
    first = Window.partitionBy("ticker", "segment").orderBy("row_no")
    best = Window.partitionBy("ticker").orderBy(F.col("exposure").desc_nulls_last(), "row_no")
    return (
        universe.withColumn("_rn", F.row_number().over(first))
        .filter("_rn = 1")
        .join(eta, "segment")
        .withColumn("_rn", F.row_number().over(best))
        .filter("_rn = 1")
        .select("ticker", "segment", "eta", "confidence")
    )
