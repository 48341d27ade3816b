"""Raw sub-score extractors, generic over the grouping (segment, or segment and as_of)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.constants import PEAK_CAPACITY_GAP_DAYS, SOURCE_PRIORITY
from tidemark.session import literal_frame

BY = ["segment"]


def _valued(signals: DataFrame, name: str) -> DataFrame:
    return signals.filter((F.col("signal_name") == name) & F.col("value_num").isNotNull())


def growth(signals: DataFrame, name: str, lag: int = 12, by: list[str] = BY) -> DataFrame:
    """Positional growth of one named series, last row per group.

    Several rows of one date are separate points, as the positional rule has it;
    aggregate first where that is not wanted.
    """
    order = Window.partitionBy(*by).orderBy("observed_at", "value_num")
    newest = Window.partitionBy(*by).orderBy(F.col("observed_at").desc(), F.col("value_num").desc())
    base = F.col("base")
    return (
        _valued(signals, name)
        .withColumn("base", F.lag("value_num", lag).over(order))
        .withColumn("rn", F.row_number().over(newest))
        .filter("rn = 1")
        .select(*by, F.when(base > 0, (F.col("value_num") - base) / base).alias("growth"))
    )


def latest(signals: DataFrame, name: str, min_n: int = 1, by: list[str] = BY) -> DataFrame:
    """Newest value of a named series; null below ``min_n`` points."""
    return (
        _valued(signals, name)
        .groupBy(*by)
        .agg(
            F.max_by("value_num", F.struct("observed_at", "value_num")).alias("value"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(*by, F.when(F.col("n") >= min_n, F.col("value")).alias("value"))
    )


def pair_latest(
    signals: DataFrame, left: str, right: str, by: list[str], max_gap: int = PEAK_CAPACITY_GAP_DAYS
) -> DataFrame:
    """Newest left and newest right value, chosen apart, if close enough in time."""
    is_left, is_right = F.col("signal_name") == left, F.col("signal_name") == right
    key = F.struct("observed_at", "value_num")
    return (
        signals.filter((is_left | is_right) & F.col("value_num").isNotNull())
        .groupBy(*by)
        .agg(
            F.max_by("value_num", F.when(is_left, key)).alias("left_v"),
            F.max(F.when(is_left, F.col("observed_at"))).alias("left_at"),
            F.max_by("value_num", F.when(is_right, key)).alias("right_v"),
            F.max(F.when(is_right, F.col("observed_at"))).alias("right_at"),
        )
        .filter((F.col("right_v") > 0) & (F.abs(F.datediff("left_at", "right_at")) <= max_gap))
        .select(*by, "left_v", "right_v")
    )


def mean_clamped_ratio(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Average over regions of min(left / right, 1)."""
    return pairs.groupBy(*group).agg(F.avg(F.least(F.col("left_v") / F.col("right_v"), F.lit(1.0))).alias("ratio"))


def forward_over_operating(
    signals: DataFrame, by: list[str] = BY, forward: str = "planned_capacity_mw", operating: str = "capacity_mw"
) -> DataFrame:
    """All forward additions over the largest operating level."""
    total = F.sum(F.when(F.col("signal_name") == forward, F.col("value_num")))
    level = F.max(F.when(F.col("signal_name") == operating, F.col("value_num")))
    return (
        signals.filter(F.col("signal_name").isin(forward, operating))
        .groupBy(*by)
        .agg(total.alias("total"), level.alias("level"))
        .select(*by, F.when(F.col("level") > 0, F.col("total") / F.col("level")).alias("ratio"))
    )


def phrase_zscore(
    signals: DataFrame, names: list[str], by: list[str] = BY, months: int = 12, min_months: int = 6
) -> DataFrame:
    """Z-score of the newest monthly phrase count."""
    monthly = (
        signals.filter(F.col("signal_name").isin(*names) & F.col("value_num").isNotNull())
        .groupBy(*by, F.trunc("observed_at", "month").alias("month"))
        .agg(F.sum("value_num").alias("value"))
    )
    newest = Window.partitionBy(*by).orderBy(F.col("month").desc())
    past = F.col("rn") > 1
    stats = (
        monthly.withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= months)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.when(~past, F.col("value"))).alias("last"),
            F.avg(F.when(past, F.col("value"))).alias("mean"),
            F.stddev_pop(F.when(past, F.col("value"))).alias("std"),
            (F.min(F.when(past, F.col("value"))) == F.max(F.when(past, F.col("value")))).alias("flat"),
        )
    )
    z = F.when(F.col("flat"), F.signum(F.col("last") - F.col("mean"))).otherwise(
        (F.col("last") - F.col("mean")) / F.col("std")
    )
    return stats.filter(F.col("n") >= min_months).select(*by, z.alias("z"))


def quarterly_totals(ledger: DataFrame, by: list[str] = BY) -> DataFrame:
    """Total and distinct tickers per quarter."""
    return ledger.groupBy(*by, "quarter").agg(
        F.sum("value").alias("total"), F.countDistinct("ticker").alias("n_tickers")
    )


def latest_quarter(quarterly: DataFrame, by: list[str] = BY) -> DataFrame:
    """The newest quarter and its total."""
    return quarterly.groupBy(*by).agg(F.max("quarter").alias("quarter"), F.max_by("total", "quarter").alias("total"))


def ttm_shift(quarterly: DataFrame, k: int = 1, by: list[str] = BY) -> DataFrame:
    """A10: k=1 is the published rule, k=4 a true year-on-year change."""
    order = Window.partitionBy(*by).orderBy("quarter")
    trailing = order.rowsBetween(-3, 0)
    newest = Window.partitionBy(*by).orderBy(F.col("quarter").desc())
    return (
        quarterly.withColumn("ttm", F.sum("total").over(trailing))
        .withColumn("n", F.row_number().over(order))
        .withColumn("prior", F.when(F.col("n") >= 4 + k, F.lag("ttm", k).over(order)))
        .withColumn("rn", F.row_number().over(newest))
        .filter("rn = 1")
        .select(*by, F.when(F.col("prior") > 0, (F.col("ttm") - F.col("prior")) / F.col("prior")).alias("ratio"))
    )


def source_priority(spark: SparkSession, table: dict = SOURCE_PRIORITY) -> DataFrame:
    """X7 as data: (sub_score, profile, source_key, priority), a fixed small table."""
    rows = [
        (sub_score, profile, source, rank)
        for sub_score, profiles in table.items()
        for profile, sources in profiles.items()
        for rank, source in enumerate(sources)
    ]
    return literal_frame(spark, rows, "sub_score string, profile string, source_key string, priority int")


def pick_source(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Per sub-score the non-null candidate of the best priority.

    ``candidates`` has (by, profile, sub_score, source_key, raw), one row per source. Only
    numbers are aggregated, in place; the source's name is looked up again by its rank.
    """
    order = F.broadcast(source_priority(candidates.sparkSession))
    ranks = range(max(len(s) for profiles in SOURCE_PRIORITY.values() for s in profiles.values()))
    best = (
        candidates.filter(F.col("raw").isNotNull())
        .join(order, ["sub_score", "profile", "source_key"])
        .groupBy(*by, "profile", "sub_score")
        .agg(
            F.min("priority").alias("priority"),
            *[F.max(F.when(F.col("priority") == k, F.col("raw"))).alias(f"_raw{k}") for k in ranks],
        )
    )
    raw = F.coalesce(*[F.col(f"_raw{k}") for k in ranks])
    return best.join(order, ["sub_score", "profile", "priority"]).select(
        *by, "profile", "sub_score", raw.alias("raw"), "source_key"
    )
