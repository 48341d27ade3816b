"""Closes as of a date, forward returns, evaluation points, basket metrics, drawdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import COST_PER_NAME, TRADING_DAYS
from tidemark.operators.temporal import asof_join
from tidemark.session import written


def close_asof(probes: DataFrame, prices: DataFrame, ts: str = "t") -> DataFrame:
    """Bar at or before each (ticker, t); one row per ticker and day bounds the window."""
    bars = prices.select("ticker", F.col("date").alias("bar_date"), "close")
    return asof_join(probes, bars, ["ticker"], ts, "bar_date", ["bar_date", "close"])


def bars_of(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """The bars of held tickers: baskets hold few of all, and a window over the others' bars is for nothing."""
    return prices.join(holdings.select("ticker").distinct(), "ticker", "left_semi")


def forward_return(probes: DataFrame, prices: DataFrame, days: int, require_complete: bool = False) -> DataFrame:
    """Return from the bar at t to the bar at t + days.

    Both lookups go through one as-of pass. Null when the first bar is missing or not
    positive, or when both ends hit the same bar. ``require_complete`` also drops
    horizons that run past a ticker's last bar.
    """
    ends = probes.select("ticker", "t").distinct()
    asks = ends.select(
        "ticker",
        "t",
        F.explode(
            F.array(
                F.struct(F.col("t").alias("at"), F.lit(False).alias("is_end")),
                F.struct(F.date_add("t", days).alias("at"), F.lit(True).alias("is_end")),
            )
        ).alias("ask"),
    ).select("ticker", "t", "ask.at", "ask.is_end")
    hits = close_asof(asks, prices, ts="at").groupBy("ticker", "t").agg(
        F.max(F.when(~F.col("is_end"), F.struct("bar_date", "close"))).alias("a"),
        F.max(F.when(F.col("is_end"), F.struct("bar_date", "close"))).alias("z"),
    )
    a, z = F.col("a.close"), F.col("z.close")
    ret = F.when((a > 0) & (F.col("a.bar_date") != F.col("z.bar_date")), (z - a) / a)
    if require_complete:
        last_bar = prices.groupBy("ticker").agg(F.max("date").alias("last_bar"))
        hits = hits.join(last_bar, "ticker", "left")
        ret = F.when(F.col("last_bar") >= F.date_add("t", days), ret)
    return hits.select("ticker", "t", ret.alias("ret"))


def universe_grid(universe: DataFrame, dates: Column) -> DataFrame:
    """One row per distinct ticker and evaluation date."""
    return universe.select("ticker").distinct().withColumn("t", F.explode(dates))


def scores_asof(history: DataFrame, segments: DataFrame, dates: Column) -> DataFrame:
    """J1 on a score history: (segment, t, b, b_prime, regime); misses are dropped."""
    probes = segments.select("segment").distinct().withColumn("t", F.explode(dates))
    known = history.filter(F.col("b").isNotNull()).select(
        "segment", "as_of", "b", F.coalesce("b_prime", F.lit(0.0)).alias("b_prime"), "regime"
    )
    hit = asof_join(probes, known, ["segment"], "t", "as_of", ["b", "b_prime", "regime"])
    return hit.filter(F.col("b").isNotNull())


def universe_returns(
    universe: DataFrame, dates: Column, prices: DataFrame, days: int, require_complete: bool = False
) -> DataFrame:
    """(ticker, t, ret) where the return exists; scores have no part in it, so the modes of a backtest share it."""
    return forward_return(universe_grid(universe, dates), prices, days, require_complete).filter("ret IS NOT NULL")


def eval_points(
    universe: DataFrame,
    dates: Column,
    history: DataFrame,
    prices: DataFrame,
    days: int,
    require_complete: bool = False,
    returns: DataFrame | None = None,
) -> DataFrame:
    """(ticker, segment, t, b, ret, regime) where both the score and the return exist.

    Returns are computed once per ticker and joined to its segments afterwards; ``returns`` gives them if another
    mode's points have them already. Scores are one row per (segment, t): they are written first, so that
    Spark sees their size and the points need not be shuffled to meet them.
    """
    listing = universe.select("ticker", "segment").distinct()
    if returns is None:
        returns = universe_returns(listing, dates, prices, days, require_complete)
    scores = written(scores_asof(history, listing, dates), "scores")
    return (
        returns.join(listing, "ticker")
        .join(scores, ["segment", "t"])
        .select("ticker", "segment", "t", "b", "ret", "regime")
    )


def paired_scores(history_a: DataFrame, history_b: DataFrame, segments: DataFrame, dates: Column) -> DataFrame:
    """(segment, t, b_a, regime_a, b_b, regime_b) where both histories have a score."""

    def side(history: DataFrame, tag: str) -> DataFrame:
        return scores_asof(history, segments, dates).select(
            "segment", "t", F.col("b").alias(f"b_{tag}"), F.col("regime").alias(f"regime_{tag}")
        )

    return side(history_a, "a").join(side(history_b, "b"), ["segment", "t"])


def paired_points(
    universe: DataFrame,
    dates: Column,
    history_a: DataFrame,
    history_b: DataFrame,
    prices: DataFrame,
    days: int,
    require_complete: bool = False,
) -> DataFrame:
    """J14 from two histories: (segment, t, ticker, b_a, regime_a, b_b, regime_b), as ``pair_modes`` of their points.

    Two points of one key differ in their scores only. So the scores are paired, a row per (segment, t), and
    the returns are found once: no points are stored, made distinct or matched with those of the other mode.
    """
    listing = universe.select("ticker", "segment").distinct()
    scores = written(paired_scores(history_a, history_b, listing, dates), "paired_scores")
    returns = universe_returns(listing, dates, prices, days, require_complete).select("ticker", "t")
    return (
        returns.join(listing, "ticker")
        .join(scores, ["segment", "t"])
        .select("segment", "t", "ticker", "b_a", "regime_a", "b_b", "regime_b")
    )


def basket_metrics(entries: DataFrame, returns: DataFrame, days: int, cost: float = COST_PER_NAME) -> DataFrame:
    """One aggregation per (t, side); cost counts every held name, returns only priced ones."""
    held = entries.join(returns, ["ticker", "t"], "left")
    priced = F.col("ret").isNotNull()
    n_priced = F.count("ret")
    gross = F.sum(F.col("weight") * F.col("ret")) / F.sum(F.when(priced, F.col("weight")))
    return held.groupBy("t", "side").agg(
        gross.alias("gross"),
        (gross - F.lit(cost) * F.count(F.lit(1))).alias("net"),
        (F.when(n_priced >= 2, F.stddev_samp("ret")) * (TRADING_DAYS / days) ** 0.5).alias("vol"),
        (F.count(F.when(F.col("ret") > 0, 1)) / F.nullif(n_priced, F.lit(0))).alias("hit_rate"),
        (n_priced / F.count(F.lit(1))).alias("coverage"),
        F.count(F.lit(1)).alias("n_held"),
    )


def common_dates(holdings: DataFrame, prices: DataFrame, basket: list[str], days: int) -> DataFrame:
    """Dates in [t, t + days] on which every holding of a basket has a bar.

    ``holdings`` is (basket, ticker); relational division by comparing counts.
    """
    sized = holdings.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*basket)))
    return (
        sized.join(prices, "ticker")
        .filter(F.col("date").between(F.col("t"), F.date_add("t", days)))
        .groupBy(*basket, "date")
        .agg(F.count(F.lit(1)).alias("_have"), F.max("_n").alias("_n"))
        .filter(F.col("_have") == F.col("_n"))
        .select(*basket, "date")
    )


def running_peak(values: DataFrame, by: list[str]) -> DataFrame:
    """Largest value so far, per date order."""
    past = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return values.withColumn("peak", F.max("value").over(past))


def portfolio_values(entries: DataFrame, returns: DataFrame, prices: DataFrame, days: int) -> DataFrame:
    """Weighted value of the priced holdings on their common dates, from 1 at t."""
    priced = entries.join(returns.filter("ret IS NOT NULL").select("ticker", "t"), ["ticker", "t"])
    basket = Window.partitionBy("t", "side")
    held = (
        priced.withColumn("_w", F.col("weight") / F.sum("weight").over(basket))
        .withColumn("_n", F.count(F.lit(1)).over(basket))
        .select("t", "side", "ticker", "_w", "_n")
    )
    starts = close_asof(held.select("ticker", "t").distinct(), prices).select(
        "ticker", "t", F.col("close").alias("_start")
    )
    return (
        held.join(starts, ["ticker", "t"])
        .join(prices, "ticker")
        .filter(F.col("date").between(F.col("t"), F.date_add("t", days)))
        .groupBy("t", "side", "date")
        .agg(
            F.sum(F.col("_w") * F.col("close") / F.col("_start")).alias("value"),
            F.count(F.lit(1)).alias("_have"),
            F.max("_n").alias("_n"),
        )
        .filter(F.col("_have") == F.col("_n"))
        .select("t", "side", "date", "value")
    )


def max_drawdown(entries: DataFrame, returns: DataFrame, prices: DataFrame, days: int) -> DataFrame:
    """Deepest fall from the running peak; null with fewer than two common dates."""
    values = running_peak(portfolio_values(entries, returns, prices, days), ["t", "side"])
    fall = F.least(F.min(F.col("value") / F.col("peak") - 1.0), F.lit(0.0))
    return values.groupBy("t", "side").agg(
        F.when(F.count(F.lit(1)) >= 2, fall).alias("max_drawdown"), F.count(F.lit(1)).alias("n_dates")
    )


def basket_curve(metrics: DataFrame, side: str, ret: str = "gross") -> DataFrame:
    """Compounded return of one side; each return keeps its own date."""
    order = Window.partitionBy("side").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    kept = metrics.filter((F.col("side") == side) & F.col(ret).isNotNull())
    growth = F.exp(F.sum(F.when(F.col(ret) > -1, F.log1p(ret))).over(order))
    wiped = F.max((F.col(ret) <= -1).cast("int")).over(order) == 1
    return kept.select("t", "side", F.col(ret).alias("ret"), F.when(wiped, 0.0).otherwise(growth).alias("cumulative"))


def average_return(metrics: DataFrame, ret: str = "gross") -> DataFrame:
    """Mean basket return per side, missing ones skipped."""
    return metrics.groupBy("side").agg(F.avg(ret).alias("avg_return"), F.count(ret).alias("n"))
