"""Seed fallback, normalization, weighted score, momentum and regime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.constants import (
    BANDS,
    HHI_SEED_GAP,
    MOMENTUM_CAP,
    MOMENTUM_DAYS,
    MOMENTUM_NEAR_ZERO,
    ROLLING_DAYS,
    ROLLING_HIGH,
    ROLLING_LOW,
    ROLLING_MIN_SPAN,
    WEIGHTS,
)
from tidemark.functions.bands import band_diverges, input_confidence, map_to_band, winsor_band
from tidemark.functions.regimes import classify, fast_resolve
from tidemark.operators.order_stats import trailing_picks
from tidemark.session import literal_frame


def bands_frame(spark: SparkSession, bands: list[tuple] = BANDS) -> DataFrame:
    """A fixed table of a few rows, safe to broadcast."""
    return literal_frame(spark, bands, "sub_score string, source_key string, band_min double, band_max double")


def weights_frame(spark: SparkSession, weights: dict = WEIGHTS) -> DataFrame:
    """(horizon, sub_score, w), a fixed table of a few rows."""
    rows = [(h, name, w) for h, per_name in weights.items() for name, w in per_name.items()]
    return literal_frame(spark, rows, "horizon string, sub_score string, w double")


def with_seed(grid: DataFrame, picked: DataFrame, seed: DataFrame, hhi_gap: float = HHI_SEED_GAP) -> DataFrame:
    """The dynamic value, or the seed.

    ``grid`` has one row per (segment, as_of, sub_score) wanted, ``seed`` is
    (segment, sub_score, seed_value). Capacity has no seed and stays null. A
    concentration far from its seed falls back to the seed as well.
    """
    joined = grid.join(picked, ["segment", "as_of", "sub_score"], "left").join(seed, ["segment", "sub_score"], "left")
    off = (F.col("sub_score") == "geo_concentration") & (F.abs(F.col("raw") - F.col("seed_value")) > hhi_gap)
    live = F.col("raw").isNotNull() & ~F.coalesce(off, F.lit(False))
    return joined.select(
        "segment",
        "as_of",
        "sub_score",
        F.when(live, F.col("raw")).otherwise(F.col("seed_value")).alias("raw"),
        F.when(live, F.col("source_key"))
        .when(F.col("seed_value").isNotNull(), "seed")
        .otherwise("imputed")
        .alias("source_key"),
        "seed_value",
    )


def with_band(df: DataFrame, bands: DataFrame | None = None) -> DataFrame:
    """Band of (sub_score, source_key), else the sub-score's seed band, else (0, 1)."""
    # the published table is a few rows; a caller's own is left to Spark's check of its size
    hint = F.broadcast if bands is None else (lambda table: table)
    bands = hint(bands_frame(df.sparkSession) if bands is None else bands)
    fallback = hint(
        bands.filter(F.col("source_key") == "seed").select(
            "sub_score", F.col("band_min").alias("_seed_min"), F.col("band_max").alias("_seed_max")
        )
    )
    return (
        df.join(bands, ["sub_score", "source_key"], "left")
        .join(fallback, "sub_score", "left")
        .withColumn("band_min", F.coalesce("band_min", "_seed_min", F.lit(0.0)))
        .withColumn("band_max", F.coalesce("band_max", "_seed_max", F.lit(1.0)))
        .drop("_seed_min", "_seed_max")
    )


def day_number(date_col: str) -> Column:
    return F.unix_date(F.col(date_col))


def rolling_band(
    raw_history: DataFrame, by: list[str], days: int = ROLLING_DAYS, lo: float = ROLLING_LOW, hi: float = ROLLING_HIGH, daily: bool = False
) -> DataFrame:
    """W3 + W9: winsorized band, count and span of the values before each row.

    A frame of a monthly history holds about sixty values and is sorted where it lies. A ``daily`` history is
    walked once per series, with the same result.
    """
    if daily:
        picks = lambda n: [int(n * lo), min(int(n * hi), n - 1)]
        out = trailing_picks(raw_history, by, "raw", days, picks)
        low, high = F.get("_picked", F.lit(0)), F.get("_picked", F.lit(1))
        some = (F.col("_n") >= 2) & (low != high)
        return out.select(
            *raw_history.columns,
            F.when(some, low).alias("lo_v"),
            F.when(some, high).alias("hi_v"),
            F.col("_n").alias("n"),
            F.coalesce(F.col("_last") - F.col("_first"), F.lit(0)).alias("span_days"),
        )
    before = Window.partitionBy(*by).orderBy(day_number("as_of")).rangeBetween(-days, -1)
    known = F.when(F.col("raw").isNotNull(), F.col("as_of"))
    out = (
        raw_history.withColumn("_hist", F.sort_array(F.collect_list("raw").over(before)))
        .withColumn("n", F.size("_hist"))
        .withColumn(
            "span_days", F.coalesce(F.datediff(F.max(known).over(before), F.min(known).over(before)), F.lit(0))
        )
        .withColumn("_band", winsor_band(F.col("_hist"), lo, hi))
    )
    return out.select(
        *raw_history.columns, F.col("_band.lo_v").alias("lo_v"), F.col("_band.hi_v").alias("hi_v"), "n", "span_days"
    )


def history_span(raw_history: DataFrame, by: list[str]) -> DataFrame:
    """Days between the first and last known value of a series."""
    known = raw_history.filter(F.col("raw").isNotNull())
    return known.groupBy(*by).agg(
        F.datediff(F.max("as_of"), F.min("as_of")).alias("span_days"), F.count(F.lit(1)).alias("n")
    )


def normalize(df: DataFrame, mode: str) -> DataFrame:
    """Every raw input to [0, 1] with its provenance.

    Expects the fixed band (J7); in rolling mode also lo_v, hi_v, n, span_days (W3).
    """
    is_seed = (F.col("source_key") == "seed") & F.col("raw").isNotNull()
    imputed = F.col("raw").isNull()
    if mode == "rolling":
        usable = (F.col("span_days") >= ROLLING_MIN_SPAN) & (F.col("n") >= 2) & F.col("lo_v").isNotNull()
        low = F.when(usable, F.col("lo_v")).otherwise(F.col("band_min"))
        high = F.when(usable, F.col("hi_v")).otherwise(F.col("band_max"))
        used = F.when(is_seed | imputed, "fixed").when(usable, "rolling").otherwise("fallback_to_fixed")
        span = F.col("span_days")
        diverges = band_diverges(F.col("lo_v"), F.col("hi_v"), F.col("band_min"), F.col("band_max")) & usable
    else:
        low, high, used, span = F.col("band_min"), F.col("band_max"), F.lit("fixed"), F.lit(0)
        diverges = F.lit(False)
    source = F.when(is_seed, "seed").when(imputed, "imputed").otherwise("extractor")
    value = F.when(is_seed, F.col("raw")).when(imputed, 0.5).otherwise(map_to_band(F.col("raw"), low, high))
    return df.select(
        *[c for c in df.columns if c not in ("lo_v", "hi_v", "n", "band_min", "band_max", "span_days")],
        value.alias("value"),
        source.alias("source"),
        imputed.alias("imputed"),
        used.alias("mode_used"),
        input_confidence(source, used, span).alias("confidence"),
        (~is_seed & ~imputed & F.coalesce(diverges, F.lit(False))).alias("band_diverges"),
        F.when(is_seed, 0.0).otherwise(low).alias("band_min"),
        F.when(is_seed, 1.0).otherwise(high).alias("band_max"),
        span.alias("span_days"),
    )



def weighted_score(subscores: DataFrame, by: list[str], weights: DataFrame | None = None) -> DataFrame:
    """A1 + A2: B, completeness and seed share per (by, horizon), one aggregation.

    B adds its few terms in the order of their names, so equal inputs give equal scores to the last bit on every date:
    a momentum of exactly zero decides between regimes.
    """
    weights = F.broadcast(weights_frame(subscores.sparkSession)) if weights is None else weights
    w = F.col("w")
    seeded = (F.col("source") == "seed") & ~F.col("imputed")
    return (
        subscores.join(weights, "sub_score")
        .groupBy(*by, "horizon")
        .agg(
            F.array_sort(F.collect_list(F.when((w * F.col("value")).isNotNull(), F.struct("sub_score", (w * F.col("value")).alias("term"))))).alias("_terms"),
            (1.0 - F.sum(F.when(F.col("imputed"), w).otherwise(0.0))).alias("completeness"),
            F.sum(F.when(seeded, w).otherwise(0.0)).alias("seed_share"),
        )
        .withColumn("b", F.when(F.size("_terms") > 0, F.aggregate("_terms", F.lit(0.0), lambda total, t: total + t["term"]) * 100.0))
        .select(*by, "horizon", "b", "completeness", "seed_share")
    )


def subscore_maps(subscores: DataFrame, by: list[str]) -> DataFrame:
    """A3: sub-score, raw and provenance maps; at most five entries per row."""

    def as_map(value: Column) -> Column:
        entries = F.array_sort(F.collect_list(F.struct(F.col("sub_score").alias("key"), value.alias("value"))))
        return F.map_from_entries(entries)

    provenance = F.struct("source", "confidence", "imputed")
    return subscores.groupBy(*by).agg(
        as_map(F.col("value")).alias("sub_scores"),
        as_map(F.col("raw")).alias("raw"),
        as_map(provenance).alias("provenance"),
    )


def trailing_median(history: DataFrame, by: list[str], days: int = MOMENTUM_DAYS, daily: bool = False) -> DataFrame:
    """Median of B over [t - days, t), the row itself excluded."""
    if daily:
        out = trailing_picks(history, by, "b", days, lambda n: [(n - 1) // 2, n // 2])
        return out.select(*history.columns, (F.get("_picked", F.lit(0)) * 0.5 + F.get("_picked", F.lit(1)) * 0.5).alias("base"))
    before = Window.partitionBy(*by).orderBy(day_number("as_of")).rangeBetween(-days, -1)
    return history.withColumn("base", F.percentile("b", F.lit(0.5)).over(before))


def momentum_of(b: Column, base: Column) -> Column:
    """Percent change against the base, capped; no base -> 0, tiny base -> cap."""
    raw = 100.0 * (b - base) / base
    return (
        F.when(b.isNull(), None)
        .when(base.isNull(), 0.0)
        .when(base < MOMENTUM_NEAR_ZERO, MOMENTUM_CAP)
        .otherwise(F.greatest(F.lit(-MOMENTUM_CAP), F.least(F.lit(MOMENTUM_CAP), raw)))
    )


def momentum(history: DataFrame, by: list[str] = ["segment", "horizon", "mode"], daily: bool = False) -> DataFrame:  # noqa: B006
    """W1 + W2."""
    return trailing_median(history, by, daily=daily).withColumn("b_prime", momentum_of(F.col("b"), F.col("base")))


def with_regime(history: DataFrame) -> DataFrame:
    """X5 on a scored history."""
    regime = classify(F.col("b"), F.col("b_prime"), F.col("completeness"))
    out = history.withColumn("regime", regime)
    return out.withColumn("fast_resolve", fast_resolve(F.col("regime"), F.col("b_prime")))


def confidence_at(age: Column) -> Column:
    """Confidence by days of history."""
    return F.when(age < 90, "low").when(age < 180, "medium").otherwise("high")


def age_confidence(history: DataFrame, by: list[str] = ["segment", "horizon", "mode"]) -> DataFrame:  # noqa: B006
    """Confidence from the days since a segment was first scored."""
    first = F.min("as_of").over(Window.partitionBy(*by))
    return history.withColumn("first_at", first).withColumn("confidence", confidence_at(F.datediff("as_of", "first_at")))
