"""Band normalization expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.constants import ROLLING_HIGH, ROLLING_LOW, ROLLING_MATURE_SPAN


def map_to_band(raw: Column, low: Column, high: Column) -> Column:
    """Clamp ``raw`` into [low, high] and scale to [0, 1]; flat band -> 0.5."""
    return (
        F.when(raw.isNull(), None)
        .when(high == low, 0.5)
        .when(raw <= low, 0.0)
        .when(raw >= high, 1.0)
        .otherwise((raw - low) / (high - low))
    )


def winsor_band(history: Column, low_q: float = ROLLING_LOW, high_q: float = ROLLING_HIGH) -> Column:
    """W3 tail: index quantiles of a sorted array, as struct(lo_v, hi_v).

    Null when there are fewer than two values or the ends coincide. The index is
    the truncated position n*q, which is not what ``percentile`` computes.
    """
    n = F.size(history)
    low = F.element_at(history, (n.cast("double") * F.lit(low_q)).cast("int") + 1)
    high = F.element_at(history, F.least((n.cast("double") * F.lit(high_q)).cast("int"), n - 1) + 1)
    return F.when((n >= 2) & (low != high), F.struct(low.alias("lo_v"), high.alias("hi_v")))


def input_confidence(source: Column, mode_used: Column, span_days: Column) -> Column:
    """How far one normalized input can be trusted."""
    return (
        F.when(source.isin("imputed", "seed"), "low")
        .when((mode_used == "rolling") & (span_days < ROLLING_MATURE_SPAN), "medium")
        .otherwise("high")
    )


def band_diverges(low: Column, high: Column, fixed_low: Column, fixed_high: Column) -> Column:
    """The rolling band is far wider than the fixed one."""
    return F.coalesce((low < fixed_low / 2) | (high > fixed_high * 2), F.lit(False))
