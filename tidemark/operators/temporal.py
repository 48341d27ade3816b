"""Point-in-time visibility, deduplication and as-of lookups.

Visibility is handled in interval form: each row is visible on the monthly grid
from ``visible_from`` until ``visible_until`` (exclusive), so one plan serves all
as-of dates and no driver loop is needed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import (
    IDEMPOTENT_SOURCES,
    LOOKAHEAD_DAYS,
    LOOKAHEAD_SIGNALS,
    SIGNAL_LOOKBACK_DAYS,
)
from tidemark.functions.grids import day_ceil, month_ceil


def available_at() -> Column:
    """Publication time if the source tells it, arrival time otherwise."""
    return F.coalesce(F.col("released_at"), F.col("ingested_at"))


def window_signals(signals: DataFrame, as_of: dt.date, lookback: int = SIGNAL_LOOKBACK_DAYS) -> DataFrame:
    """observations of the trailing window, both ends inclusive."""
    start = as_of - dt.timedelta(days=lookback)
    return signals.filter((F.col("observed_at") >= F.lit(start)) & (F.col("observed_at") <= F.lit(as_of)))


def lookahead_signals(
    signals: DataFrame, as_of: dt.date, names: tuple[str, ...] = LOOKAHEAD_SIGNALS, days: int = LOOKAHEAD_DAYS
) -> DataFrame:
    """forward-dated rows of the named signals, (as_of, as_of + days]."""
    end = as_of + dt.timedelta(days=days)
    return signals.filter(
        F.col("signal_name").isin(*names)
        & (F.col("observed_at") > F.lit(as_of))
        & (F.col("observed_at") <= F.lit(end))
    )


def scoring_window(signals: DataFrame, as_of: dt.date) -> DataFrame:
    """The trailing window together with the look-ahead rows."""
    return window_signals(signals, as_of).unionByName(lookahead_signals(signals, as_of))


def visible_on(signals: DataFrame, as_of: dt.date, lookahead: tuple[str, ...] = LOOKAHEAD_SIGNALS) -> DataFrame:
    """F3 for one date: published by ``as_of`` and describing no later period.

    Look-ahead signals are gated by publication only; pass ``lookahead=()`` to
    bound every signal by its period.
    """
    moment = F.lit(dt.datetime.combine(as_of, dt.time())).cast("timestamp_ntz")
    period_ok = F.col("observed_at") <= F.lit(as_of)
    if lookahead:
        period_ok = period_ok | F.col("signal_name").isin(*lookahead)
    return signals.filter((available_at() <= moment) & period_ok)


def with_visibility(
    signals: DataFrame,
    lookback: int = SIGNAL_LOOKBACK_DAYS,
    lookahead: tuple[str, ...] = LOOKAHEAD_SIGNALS,
    lookahead_days: int = LOOKAHEAD_DAYS,
    grid: str = "month",
) -> DataFrame:
    """First and last+1 date of the grid (month starts, or every day) at which a row can enter a score.

    ``visible_from`` is the first date by which the row is published and
    inside the window, ``visible_until`` the first at which it left the window.
    """
    if grid == "day":
        observed = F.col("observed_at")
        ahead = F.col("signal_name").isin(*lookahead) if lookahead else F.lit(False)
        enters = F.when(ahead, F.date_sub(observed, lookahead_days)).otherwise(observed)
        return signals.withColumn("visible_from", F.greatest(day_ceil(available_at()), enters)).withColumn("visible_until", F.date_add(observed, lookback + 1))
    observed = F.col("observed_at")
    ahead = F.col("signal_name").isin(*lookahead) if lookahead else F.lit(False)
    published = month_ceil(available_at())
    enters = F.when(ahead, month_ceil(F.date_sub(observed, lookahead_days))).otherwise(month_ceil(observed))
    leaves = F.add_months(F.trunc(F.date_add(observed, lookback), "month"), 1)
    return signals.withColumn("visible_from", F.greatest(published, enters)).withColumn("visible_until", leaves)


def dedupe_intervals(
    rows: DataFrame,
    idempotent_sources: tuple[str, ...] = IDEMPOTENT_SOURCES,
    key: tuple[str, ...] = ("segment", "signal_name", "source_id"),
) -> DataFrame:
    """W6 over all as-of dates: at each date the last ingested of the visible copies counts.

    Copies of one key with the same months of visibility are reduced first by a mergeable
    aggregate, so a key holds at most one row per pair of months however many re-emissions
    there are. Its calendar is then cut at every start and end, and each piece goes to the
    newest copy that covers it: a copy counts again once a newer one has left the window.
    Equal arrival times fall to the later period, then to the larger row.
    """
    repeated = F.col("source").isin(*idempotent_sources)
    payload = [c for c in rows.columns if c not in (*key, "visible_from", "visible_until", "ingested_at", "observed_at")]
    ranked = F.struct("ingested_at", "observed_at", *payload)
    copies = (
        rows.filter(repeated & (F.col("visible_from") < F.col("visible_until")))
        .groupBy(*key, "visible_from", "visible_until")
        .agg(F.max(ranked).alias("row"))
        .groupBy(*key)
        .agg(F.collect_list(F.struct("row", "visible_from", "visible_until")).alias("copies"))
    )
    ends = F.concat(F.transform("copies", lambda c: c["visible_from"]), F.transform("copies", lambda c: c["visible_until"]))
    cut = copies.select(*key, "copies", F.array_sort(F.array_distinct(ends)).alias("cuts"))

    def piece(start: Column, i: Column) -> Column:
        end = F.element_at("cuts", (i + 2).cast("int"))
        alive = F.filter("copies", lambda c: (c["visible_from"] <= start) & (c["visible_until"] >= end))
        return F.struct(F.array_max(F.transform(alive, lambda c: c["row"])).alias("row"), start.alias("visible_from"), end.alias("visible_until"))

    pieces = F.transform(F.slice("cuts", 1, F.size("cuts") - 1), piece)
    newest = cut.select(*key, F.explode(pieces).alias("p")).filter(F.col("p.row").isNotNull()).select(*key, "p.row.*", "p.visible_from", "p.visible_until")
    kept = rows.filter(~repeated).unionByName(newest.select(*rows.columns))
    return kept.filter(F.col("visible_from") < F.col("visible_until"))


def dedupe_signals(
    signals: DataFrame,
    idempotent_sources: tuple[str, ...] = IDEMPOTENT_SOURCES,
    order: str = "ingested",
    as_of: dt.date | None = None,
) -> DataFrame:
    """W6 for one already gated set of rows.

    ``order='ingested'`` keeps the last ingested copy; ``order='window'`` prefers
    copies inside the window, then the latest period, then the last ingested.
    """
    key = ["segment", "signal_name", "source_id"]
    repeated = F.col("source").isin(*idempotent_sources)
    if order == "ingested":
        rank = F.struct("ingested_at", "observed_at", "value_num")
    else:
        inside = F.lit(0) if as_of is None else (F.col("observed_at") <= F.lit(as_of)).cast("int")
        rank = F.struct(inside.alias("inside"), "observed_at", "ingested_at", "value_num")
    payload = [c for c in signals.columns if c not in key]
    newest = (
        signals.filter(repeated)
        .groupBy(*key)
        .agg(F.max_by(F.struct(*payload), rank).alias("row"))
        .select(*key, "row.*")
        .select(*signals.columns)
    )
    return signals.filter(~repeated).unionByName(newest)


def keep_relevant(points: DataFrame, series: list[str], at: str, max_depth: int, depth: str = "depth") -> DataFrame:
    """Shorten visibility to where a point can be among the newest ``depth`` ones.

    Once the next ``depth`` points of the series are all visible the point can no
    longer matter, so its interval ends there. Exact for any "latest n" reader, and it
    cuts the dates a row is exploded to from the whole lookback to about ``depth``.
    ``depth`` is a column, constant per series and at most ``max_depth``; null keeps all.

    ``points`` holds merged rows, so a point has one row per month in which a version of
    it appeared; those few rows travel together and no self-join is needed.
    """
    key = [*series, at, depth]
    following = Window.partitionBy(*series).orderBy(at).rowsBetween(1, max_depth)
    superseded = F.when(F.size("_next") >= F.col(depth), F.array_max(F.slice("_next", F.lit(1), F.col(depth))))
    rest = [c for c in points.columns if c not in key]
    return (
        points.repartition(*series)
        .groupBy(*key)
        .agg(F.collect_list(F.struct(*rest)).alias("_rows"), F.min("visible_from").alias("_first_seen"))
        .withColumn("_next", F.collect_list("_first_seen").over(following))
        .withColumn("_until", superseded)
        .select(*key, "_until", F.explode("_rows").alias("_r"))
        .select(*key, "_until", "_r.*")
        .withColumn("visible_until", F.least("visible_until", "_until"))
        .drop("_until")
        .filter(F.col("visible_from") < F.col("visible_until"))
        .select(*points.columns)
    )


def explode_as_of(rows: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """One row per month start in [start, end] at which a row is visible."""
    first = F.greatest(F.col("visible_from"), F.lit(start.replace(day=1)))
    last = F.least(F.add_months("visible_until", -1), F.lit(end))
    return (
        rows.withColumn("as_of", F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))))
        .withColumn("as_of", F.explode("as_of"))
        .drop("visible_from", "visible_until")
    )


def change_dates(rows: DataFrame, by: str, start: dt.date, end: dt.date) -> DataFrame:
    """(by, cuts): the ascending dates in [start, end] at which what is visible of a ``by`` changes, ``start`` included.

    Each row is two events, its start and its end; between two dates the visible rows stay the same. Nothing is
    exploded to a grid: a ``by`` has at most as many cuts as there are days in [start, end].
    """
    inside = lambda d: (d > F.lit(start)) & (d <= F.lit(end))
    events = rows.select(by, F.explode(F.filter(F.array("visible_from", "visible_until"), inside)).alias("_cut"))
    firsts = rows.select(by, F.lit(start).alias("_cut"))
    return events.unionByName(firsts).groupBy(by).agg(F.array_sort(F.collect_set("_cut")).alias("cuts"))


def explode_changes(rows: DataFrame, cuts: DataFrame, by: str) -> DataFrame:
    """One row per change date of its ``by`` at which a row is visible, as ``as_of``."""
    there = F.filter("cuts", lambda d: (d >= F.col("visible_from")) & (d < F.col("visible_until")))
    return rows.join(cuts, by).withColumn("as_of", F.explode(there)).drop("visible_from", "visible_until", "cuts")


def fill_days(found: DataFrame, cuts: DataFrame, by: str, end: dt.date) -> DataFrame:
    """Results of change dates repeated for every day up to the day before the next change."""
    spans = cuts.select(F.col(by).alias("_by"), F.explode("cuts").alias("_from")).withColumn("_until", F.lead("_from").over(Window.partitionBy("_by").orderBy("_from")))
    last = F.coalesce(F.date_sub("_until", 1), F.lit(end))
    days = F.sequence(F.col("_from"), last, F.expr("INTERVAL 1 DAY"))
    on = (F.col(by) == F.col("_by")) & (F.col("as_of") == F.col("_from"))
    return found.join(spans, on).withColumn("as_of", F.explode(days)).select(*found.columns)


def visible_asof(signals: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """F3 for a whole month grid: (as_of, signal columns)."""
    return explode_as_of(with_visibility(signals).filter(F.col("visible_from") < F.col("visible_until")), start, end)


def mode_filter(history: DataFrame, mode: str) -> DataFrame:
    """rows written before modes existed count as ``fixed``."""
    return history.filter(F.coalesce(F.col("mode"), F.lit("fixed")) == mode)


def on_day(df: DataFrame, ts_col: str, day: dt.date) -> DataFrame:
    """half-open day bucket, kept as a range so it is pushed to the scan."""
    low = dt.datetime.combine(day, dt.time())
    return df.filter(
        (F.col(ts_col) >= F.lit(low).cast("timestamp_ntz"))
        & (F.col(ts_col) < F.lit(low + dt.timedelta(days=1)).cast("timestamp_ntz"))
    )


def asof_join(
    probes: DataFrame,
    series: DataFrame,
    by: list[str],
    probe_ts: str,
    series_ts: str,
    cols: list[str],
    strict: bool = False,
    slice_days: int | None = None,
    tie: list[str] | None = None,
) -> DataFrame:
    """Per probe, the last series row with ts <= probe ts (``<`` if strict).

    Of rows with one time the greatest by ``tie`` counts, without one the greatest by ``cols``.
    Events and probes are unioned and read by one ordered window. Leave
    ``slice_days`` unset where a key's rows are bounded by the calendar (daily bars,
    monthly scores). For raw event series set it: the window then runs inside
    (key, time slice) and only one carried value per slice crosses slices, so a hot
    key spreads over as many tasks as it has slices.
    """
    probe_cols = [c for c in probes.columns if c not in by and c != probe_ts]
    events = series.select(
        *by,
        F.col(series_ts).alias("_ts"),
        F.lit(1 if strict else 0).alias("_ord"),
        F.struct(*cols).alias("_hit"),
        F.struct(*(tie or cols)).alias("_tie"),
        F.lit(False).alias("_is_probe"),
        *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in probe_cols],
    )
    asks = probes.select(
        *by,
        F.col(probe_ts).alias("_ts"),
        F.lit(0 if strict else 1).alias("_ord"),
        F.lit(None).cast(events.schema["_hit"].dataType).alias("_hit"),
        F.lit(None).cast(events.schema["_tie"].dataType).alias("_tie"),
        F.lit(True).alias("_is_probe"),
        *probe_cols,
    )
    both = events.unionByName(asks)
    if slice_days is None:
        past = Window.partitionBy(*by).orderBy("_ts", "_ord", "_tie").rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(past)).filter("_is_probe")
    else:
        both = both.withColumn(
            "_slice", F.floor(F.datediff(F.col("_ts"), F.lit(dt.date(1970, 1, 1))) / F.lit(slice_days))
        )
        past = Window.partitionBy(*by, "_slice").orderBy("_ts", "_ord", "_tie").rowsBetween(Window.unboundedPreceding, 0)
        inside = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(past)).filter("_is_probe")
        tails = both.groupBy(*by, "_slice").agg(F.max_by("_hit", F.when(~F.col("_is_probe"), F.struct("_ts", "_tie"))).alias("_tail"))
        earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = tails.withColumn("_carry", F.last("_tail", ignorenulls=True).over(earlier)).drop("_tail")
        found = inside.join(carried, [*by, "_slice"], "left").withColumn("_hit", F.coalesce("_hit", "_carry"))
    return found.select(*by, F.col("_ts").alias(probe_ts), *probe_cols, *[F.col("_hit")[c].alias(c) for c in cols])


def previous_score(history: DataFrame, before: dt.date) -> DataFrame:
    """The newest row of each (segment, horizon) strictly before a cutoff."""
    payload = [c for c in history.columns if c not in ("segment", "horizon")]
    return (
        history.filter(F.col("as_of") < F.lit(before))
        .groupBy("segment", "horizon")
        .agg(F.max_by(F.struct(*payload), F.col("as_of")).alias("row"))
        .select("segment", "horizon", "row.*")
    )


def fetch_window(today: dt.date, daily_days: int = 730) -> Column:
    """Period to re-read for a source, by cadence: struct(since, until)."""
    first_of_month = today.replace(day=1)
    previous_month = (first_of_month - dt.timedelta(days=1)).replace(day=1)
    since = (
        F.when(F.col("cadence") == "weekly", F.lit(today - dt.timedelta(days=14)))
        .when(F.col("cadence") == "monthly", F.lit(previous_month))
        .otherwise(F.lit(today - dt.timedelta(days=daily_days)))
    )
    return F.struct(since.alias("since"), F.lit(today).alias("until"))


def due_sources(sources: DataFrame, ledger: DataFrame, now: dt.datetime) -> DataFrame:
    """Sources without a successful run inside their cadence.

    ``sources`` has (source, min_interval_days); ``ledger`` one row per run.
    """
    last_ok = ledger.filter(F.col("status") == "OK").groupBy("source").agg(F.max("last_ingested_at").alias("last_ok"))
    moment = F.lit(now).cast("timestamp_ntz")
    fresh = sources.join(last_ok, "source").filter(
        F.col("last_ok") + F.make_dt_interval(F.col("min_interval_days")) > moment
    )
    return sources.join(fresh.select("source"), "source", "left_anti")
