"""The scoring chain: signals to scores, momentum and regime at every month start."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import (
    LOOKAHEAD_DAYS,
    LOOKAHEAD_SIGNALS,
    MOMENTUM_DAYS,
    PEAK_CAPACITY_GAP_DAYS,
    ROLLING_DAYS,
    SIGNAL_LOOKBACK_DAYS,
)
from tidemark.functions.grids import days_of, month_starts
from tidemark.operators import extractors as X
from tidemark.operators import scoring as S
from tidemark.operators import temporal as T
from tidemark.session import cut_lineage

#: Column by which histories are stored.
MONTH = "computed_month"

# How a signal enters: its series name, what makes a point, how many newest points matter.
SUMMED = ("trade_volume", "lead_time_mentions", "capacity_mentions", "hyperscaler_capex")
POOLED = ("planned_capacity_mw", "capacity_mw")
DEPTHS = {
    "industrial_production": 13,
    "capacity_utilization": 1,
    "ppi_transformers": 2,
    "ppi_semis": 13,
    "book_to_bill_ratio": 1,
    "trade_volume": 13,
    "lead_time_mentions": 12,
    "capacity_mentions": 12,
    "hyperscaler_capex": 5,
    "iso_peak_load_mw": 1,
    "iso_capacity_mw": 1,
}
SUB_SCORES = ("lead_time_growth", "capacity_tightness", "geo_concentration", "regulatory_friction", "demand_signal")


def _series() -> Column:
    name = F.col("signal_name")
    return F.when(name.isin("shortage_mentions", "capacity_expansion_mentions"), "capacity_mentions").otherwise(name)


def _point() -> Column:
    series = F.col("series")
    return (
        F.when(series.isin(*POOLED), F.lit(dt.date(1970, 1, 1)))
        .when(series == "hyperscaler_capex", F.trunc("observed_at", "quarter"))
        .when(series.isin(*SUMMED), F.trunc("observed_at", "month"))
        .otherwise(F.col("observed_at"))
    )


def _depth() -> Column:
    cases = " ".join(f"WHEN '{name}' THEN {n}" for name, n in DEPTHS.items())
    return F.expr(f"CASE series {cases} END")


def visible_points(signals: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """(segment, as_of, series, geography, point) rows that can enter a score.

    Rows that become visible together are merged first (map side), intervals are cut to
    where a point matters, and only then is the grid exploded. The result is laid out by
    (segment, as_of), which serves every later aggregation without another shuffle.
    """
    relevant = _relevant(signals, start, end, "month")
    return T.explode_as_of(relevant, start, end).repartition("segment", "as_of")


def _relevant(signals: DataFrame, start: dt.date, end: dt.date, grid: str) -> DataFrame:
    """Merged points with the interval of grid dates at which each can be among those that count."""
    rows = T.dedupe_intervals(T.with_visibility(in_reach(signals, start, end), grid=grid))
    # Rows that appear after the grid or left before it can neither count nor displace any.
    in_grid = (F.col("visible_from") <= F.lit(end)) & (F.col("visible_until") > F.lit(start))
    rows = rows.filter(in_grid).withColumn("series", _series())
    key = ["segment", "series", "geography", "point", "depth"]
    merged = (
        rows.withColumn("point", _point())
        .withColumn("depth", _depth())
        .withColumn("geography", F.coalesce("geography", F.lit("")))
        .groupBy(*key, "visible_from", "visible_until")
        .agg(
            F.sum("value_num").alias("total"),
            F.max("value_num").alias("top"),
            F.max_by("value_num", F.struct("ingested_at", "value_num")).alias("newest"),
            F.max("ingested_at").alias("ingested_at"),
        )
    )
    return T.keep_relevant(merged, ["segment", "series", "geography"], "point", max(DEPTHS.values())).drop("depth")


def in_reach(signals: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Rows that can be visible at some date of [start, end], by bounds on stored columns that reach the scan."""
    low, high = start - dt.timedelta(days=SIGNAL_LOOKBACK_DAYS), end + dt.timedelta(days=LOOKAHEAD_DAYS)
    rows = signals.filter(F.col("value_num").isNotNull() & (F.col("observed_at") >= F.lit(low)) & (F.col("observed_at") <= F.lit(high)))
    if "observed_month" in signals.columns:
        month = F.col("observed_month")
        rows = rows.filter((month >= F.lit(low.replace(day=1))) & (month <= F.lit(high))).drop("observed_month")
    return rows.filter((F.col("observed_at") <= F.lit(end)) | F.col("signal_name").isin(*LOOKAHEAD_SIGNALS)).filter(T.available_at() <= F.lit(end))


def points_on(signals: DataFrame, as_of: dt.date) -> DataFrame:
    """``visible_points`` of one date, any day of a month: the gate is a plain filter, nothing is exploded."""
    rows = T.dedupe_signals(in_reach(signals, as_of, as_of)).withColumn("series", _series())
    merged = (
        rows.withColumn("point", _point())
        .withColumn("geography", F.coalesce("geography", F.lit("")))
        .groupBy("segment", "series", "geography", "point")
        .agg(
            F.sum("value_num").alias("total"),
            F.max("value_num").alias("top"),
            F.max_by("value_num", F.struct("ingested_at", "value_num")).alias("newest"),
            F.max("ingested_at").alias("ingested_at"),
        )
    )
    return merged.withColumn("as_of", F.lit(as_of)).repartition("segment", "as_of")


# Series family -> (sub-score, source key) it can feed.
FEEDS = {
    "grid": ("capacity_tightness", "iso_capacity_ratio"),
    "power": ("capacity_tightness", "power_ratio"),
    "trade_volume": ("capacity_tightness", "comtrade_volume"),
    "capacity_utilization": ("capacity_tightness", "manufacturing_utilization"),
    "capacity_mentions": ("capacity_tightness", "edgar_keyword"),
    "ppi_transformers": ("lead_time_growth", "transformers_ppi"),
    "book_to_bill_ratio": ("lead_time_growth", "semi_book_to_bill"),
    "ppi_semis": ("lead_time_growth", "semi_ppi"),
    "lead_time_mentions": ("lead_time_growth", "edgar_keyword"),
    "hyperscaler_capex": ("demand_signal", "hyperscaler_capex"),
    "industrial_production": ("demand_signal", "manufacturing_indpro"),
}
GROWTH = ("industrial_production", "ppi_semis", "trade_volume")
ZSCORE = ("lead_time_mentions", "capacity_mentions")
PEAK, CAPACITY, PLANNED, OPERATING = "iso_peak_load_mw", "iso_capacity_mw", "planned_capacity_mw", "capacity_mw"


def extracted(points: DataFrame) -> DataFrame:
    """(segment, as_of, family, raw): every extractor of every date in three stacked aggregations.

    All of them group below (segment, as_of), the layout of ``points``, so none shuffles.
    """
    series, rn = F.col("series"), F.col("rn")
    cells = points.groupBy("segment", "as_of", "series", "geography", "point").agg(
        F.sum("total").alias("total"), F.max("top").alias("top"), F.max_by("newest", F.struct("ingested_at", "newest")).alias("newest")
    )
    newest_first = Window.partitionBy("segment", "as_of", "series", "geography").orderBy(F.col("point").desc())
    value = F.when(series.isin(*SUMMED, PLANNED), F.col("total")).when(series == OPERATING, F.col("top")).otherwise(F.col("newest"))
    family = F.when(series.isin(PEAK, CAPACITY), "grid").when(series.isin(PLANNED, OPERATING), "power").otherwise(series)
    cells = cells.withColumn("value", value).withColumn("rn", F.row_number().over(newest_first)).withColumn("family", family)

    def pick(cond: Column, col: str = "value") -> Column:
        return F.when(cond, F.col(col))

    past = rn.between(2, 12)
    stats = cells.groupBy("segment", "as_of", "family", "geography").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(pick(rn == 1)).alias("last"),
        F.max(pick(rn == 13)).alias("year_ago"),
        F.avg(pick(past)).alias("mean"),
        F.stddev_pop(pick(past)).alias("std"),
        F.min(pick(past)).alias("low"),
        F.max(pick(past)).alias("high"),
        F.sum(pick(rn <= 4)).alias("ttm"),
        F.sum(pick(rn.between(2, 5))).alias("ttm_before"),
        *[F.max(pick((series == s) & (rn == 1))).alias(s) for s in (PEAK, CAPACITY, PLANNED, OPERATING)],
        F.max(pick((series == PEAK) & (rn == 1), "point")).alias("peak_at"),
        F.max(pick((series == CAPACITY) & (rn == 1), "point")).alias("cap_at"),
    )
    c = F.col
    fam = c("family")
    near = F.abs(F.datediff("peak_at", "cap_at")) <= PEAK_CAPACITY_GAP_DAYS
    raw = (
        F.when(fam == "grid", F.when(near & (c(CAPACITY) > 0), F.least(c(PEAK) / c(CAPACITY), F.lit(1.0))))
        .when(fam == "power", F.when(c(OPERATING) > 0, c(PLANNED) / c(OPERATING)))
        .when(fam.isin(*GROWTH), F.when(c("year_ago") > 0, (c("last") - c("year_ago")) / c("year_ago")))
        .when(
            fam.isin(*ZSCORE) & (c("n") >= 6),
            F.when(c("low") == c("high"), F.signum(c("last") - c("low"))).otherwise((c("last") - c("mean")) / c("std")),
        )
        .when(fam.isin(*ZSCORE), None)
        .when(
            fam == "hyperscaler_capex",
            F.when((c("n") >= 5) & (c("ttm_before") > 0), (c("ttm") - c("ttm_before")) / c("ttm_before")),
        )
        .when((fam == "ppi_transformers") & (c("n") < 2), None)
        .otherwise(c("last"))
    )
    return stats.withColumn("raw", raw).groupBy("segment", "as_of", "family").agg(F.avg("raw").alias("raw"))


def candidates(found: DataFrame, segments: DataFrame) -> DataFrame:
    """Extractor values as (segment, as_of, profile, sub_score, source_key, raw)."""
    def feed(part: int) -> Column:
        cases = " ".join(f"WHEN '{family}' THEN '{fed[part]}'" for family, fed in FEEDS.items())
        return F.expr(f"CASE family {cases} END")

    return found.join(segments.select("segment", "profile"), "segment").select(
        "segment", "as_of", "profile", feed(0).alias("sub_score"), feed(1).alias("source_key"), "raw"
    )


def raw_subscores(
    signals: DataFrame, segments: DataFrame, seed: DataFrame, hhi: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """(segment, as_of, sub_score, raw, source_key, seed_value) for every month start of [start, end]."""
    return _raw(extracted(visible_points(signals, start, end)), segments, seed, hhi, month_starts(start, end))


def raw_subscores_daily(
    signals: DataFrame, segments: DataFrame, seed: DataFrame, hhi: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """``raw_subscores`` of every day of [start, end].

    Extractors run only at the dates on which something a segment sees changes; the days between repeat them.
    """
    relevant = cut_lineage(_relevant(signals, start, end, "day"))
    cuts = cut_lineage(T.change_dates(relevant, "segment", start, end))
    points = T.explode_changes(relevant, cuts, "segment").repartition("segment", "as_of")
    return _raw(T.fill_days(extracted(points), cuts, "segment", end), segments, seed, hhi, days_of(start, end))


def raw_subscores_on(signals: DataFrame, segments: DataFrame, seed: DataFrame, hhi: DataFrame, as_of: dt.date) -> DataFrame:
    """``raw_subscores`` of one date, on whatever day it falls."""
    return _raw(extracted(points_on(signals, as_of)), segments, seed, hhi, F.array(F.lit(as_of)))


def _raw(found: DataFrame, segments: DataFrame, seed: DataFrame, hhi: DataFrame, grid: Column) -> DataFrame:
    picked = X.pick_source(candidates(found, segments), ["segment", "as_of"]).drop("profile")
    dates = segments.select("segment").withColumn("as_of", F.explode(grid))
    geo = dates.join(hhi, "segment").select(
        "segment", "as_of", F.lit("geo_concentration").alias("sub_score"), F.col("hhi").alias("raw"), F.lit("hhi").alias("source_key")
    )
    wanted = dates.withColumn("sub_score", F.explode(F.array(*[F.lit(s) for s in SUB_SCORES])))
    live = picked.select("segment", "as_of", "sub_score", "raw", "source_key").unionByName(geo)
    return S.with_seed(wanted, live, seed)


def normalized(raw: DataFrame, mode: str, daily: bool = False) -> DataFrame:
    """X2 with everything it needs; bands never mix sources. ``daily``: histories have a row a day, not a month."""
    banded = S.with_band(raw)
    if mode == "rolling":
        banded = S.rolling_band(banded, ["segment", "sub_score", "source_key"], daily=daily)
    return S.normalize(banded, mode).withColumn("mode", F.lit(mode))


def score_history(subscores: DataFrame) -> DataFrame:
    """(segment, horizon, mode, as_of) with B, momentum, regime and confidence."""
    scored = S.weighted_score(subscores, ["segment", "as_of", "mode"])
    return S.age_confidence(S.with_regime(S.momentum(scored)))


def recompute(
    raw: DataFrame, raw_history: DataFrame, score_rows: DataFrame, as_of: dt.date, mode: str, snapshot: DataFrame | None = None
) -> DataFrame:
    """A day's scores against stored history, as a daily job needs them.

    ``raw`` are the day's raw sub-scores; of ``raw_history`` only the band's years are read, of
    ``score_rows`` the momentum window. Each key's first date comes from the ``snapshot`` of an earlier day, or, without
    one, from the whole of ``score_rows``. Rows of the day itself, from an earlier run, count for nothing.
    """
    return backfill(raw, raw_history, score_rows, as_of, as_of, mode, snapshot, daily=False)


def backfill(
    raw: DataFrame, raw_history: DataFrame, score_rows: DataFrame, start: dt.date, end: dt.date, mode: str, snapshot: DataFrame | None = None, daily: bool = True
) -> DataFrame:
    """Scores of every date that ``raw`` has in [start, end], as single runs one after another would give them.

    Every date sees the stored histories from before ``start`` and the dates of ``raw`` before it; stored rows of
    [start, end] count for nothing.
    """
    key = ["segment", "horizon", "mode"]
    inside = F.col("as_of").between(F.lit(start), F.lit(end))
    past = _stored_between(raw_history, start - dt.timedelta(days=ROLLING_DAYS), start).select(*raw.columns)
    rows = past.unionByName(raw) if mode == "rolling" else raw
    found = S.weighted_score(normalized(rows, mode, daily).filter(inside), ["segment", "as_of", "mode"])
    before = T.mode_filter(score_rows, mode)
    recent = _stored_between(before, start - dt.timedelta(days=MOMENTUM_DAYS), start).select(*found.columns)
    scored = S.with_regime(S.momentum(recent.unionByName(found), daily=daily).filter(inside))
    if snapshot is not None:
        known = T.mode_filter(snapshot, mode).groupBy(*key).agg(F.min("first_at").alias("known_since"))
    else:
        known = before.filter(F.col("as_of") < F.lit(start)).groupBy(*key).agg(F.min("as_of").alias("known_since"))
    first = F.coalesce("known_since", F.min("as_of").over(Window.partitionBy(*key)) if daily else F.col("as_of"))
    aged = scored.join(known, key, "left").withColumn("first_at", first).drop("known_since")
    return aged.withColumn("confidence", S.confidence_at(F.datediff("as_of", "first_at")))


def _stored_between(history: DataFrame, first: dt.date, end: dt.date) -> DataFrame:
    """Rows of [first, end) of a history; of one that is stored by month only those months' folders are read."""
    rows = history.filter((F.col("as_of") >= F.lit(first)) & (F.col("as_of") < F.lit(end)))
    if MONTH in history.columns:
        rows = rows.filter((F.col(MONTH) >= F.lit(first.replace(day=1))) & (F.col(MONTH) <= F.lit(end))).drop(MONTH)
    return rows
