"""Visibility, deduplication, as-of and calendar queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import grids
from tidemark.operators import temporal as T
from tidemark.oracles.views import check
from tidemark.plans import fixtures as V
from tidemark.plans import store
from tidemark.plans.catalog.common import r6
from tidemark.plans.registry import query

NOW = dt.date(1999, 6, 15)
_N = "DATE '1999-06-15'"
_BY_NAME = """SELECT signal_name, CAST(COUNT(*) AS BIGINT) AS n, min(observed_at) AS first_at, max(observed_at) AS last_at,
              round(SUM(CAST(value_num AS DECIMAL(28,6))), 6)::DOUBLE AS total FROM signals WHERE {} GROUP BY ALL"""


def _by_name(df):
    return df.groupBy("signal_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("observed_at").alias("first_at"),
        F.max("observed_at").alias("last_at"),
        F.sum(F.col("value_num").cast("decimal(28,6)")).cast("double").alias("total"),
    )


@query("f1_window_signals", check(_BY_NAME.format(f"observed_at BETWEEN {_N} - 1825 AND {_N}"), "signals"))
def window_signals(spark, sf_dir):
    return _by_name(T.window_signals(store.signals(spark, sf_dir), NOW))


@query(
    "f2_lookahead_signals",
    check(_BY_NAME.format(f"signal_name = 'planned_capacity_mw' AND observed_at > {_N} AND observed_at <= {_N} + 1095"), "signals"),
)
def lookahead_signals(spark, sf_dir):
    return _by_name(T.lookahead_signals(store.signals(spark, sf_dir), NOW))


@query(
    "u1_scoring_window",
    check(
        _BY_NAME.format(
            f"observed_at BETWEEN {_N} - 1825 AND {_N} OR (signal_name = 'planned_capacity_mw' AND observed_at > {_N} AND observed_at <= {_N} + 1095)"
        ),
        "signals",
    ),
)
def scoring_window(spark, sf_dir):
    return _by_name(T.scoring_window(store.signals(spark, sf_dir), NOW))


@query(
    "f3_visible_on",
    check(
        _BY_NAME.format(
            f"coalesce(released_at, ingested_at) <= {_N} AND (observed_at <= {_N} OR signal_name = 'planned_capacity_mw')"
        ),
        "signals",
    ),
)
def visible_on(spark, sf_dir):
    return _by_name(T.visible_on(store.signals(spark, sf_dir), NOW))


@query(
    "f3_visible_on_strict",
    check(_BY_NAME.format(f"coalesce(released_at, ingested_at) <= {_N} AND observed_at <= {_N}"), "signals"),
)
def visible_on_strict(spark, sf_dir):
    return _by_name(T.visible_on(store.signals(spark, sf_dir), NOW, lookahead=()))


@query(
    "f3_visible_asof_grid",
    check(
        """SELECT as_of, segment, signal_name, CAST(COUNT(*) AS BIGINT) AS n, max(observed_at) AS last_at FROM visible GROUP BY ALL""",
        "visible",
    ),
)
def visible_asof_grid(spark, sf_dir):
    seen = T.visible_asof(store.signals(spark, sf_dir), V.GRID_START, V.GRID_END)
    return seen.groupBy("as_of", "segment", "signal_name").agg(
        F.count(F.lit(1)).alias("n"), F.max("observed_at").alias("last_at")
    )


@query(
    "w6_dedupe_all_dates",
    check(
        """SELECT as_of, segment, signal_name, CAST(COUNT(*) AS BIGINT) AS n, round(SUM(CAST(value_num AS DECIMAL(28,6))), 6)::DOUBLE AS total
           FROM deduped WHERE source = 'eia_860m' GROUP BY ALL""",
        "deduped",
    ),
)
def dedupe_all_dates(spark, sf_dir):
    rows = T.dedupe_intervals(T.with_visibility(store.signals(spark, sf_dir).filter(F.col("source") == "eia_860m")))
    return (
        T.explode_as_of(rows, V.GRID_START, V.GRID_END)
        .groupBy("as_of", "segment", "signal_name")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value_num").cast("decimal(28,6)")).cast("double").alias("total"))
    )


@query(
    "w6_dedupe_signals",
    check(
        """SELECT segment, signal_name, source_id, observed_at, round(value_num, 6) + 0.0 AS value_num FROM signals
           QUALIFY source <> 'eia_860m' OR row_number() OVER (PARTITION BY segment, signal_name, source_id ORDER BY ingested_at DESC) = 1""",
        "signals",
    ),
)
def dedupe_signals(spark, sf_dir):
    df = T.dedupe_signals(store.signals(spark, sf_dir))
    return df.select("segment", "signal_name", "source_id", "observed_at", r6("value_num"))


@query(
    "w6_dedupe_window_order",
    check(
        f"""SELECT segment, signal_name, source_id, observed_at, round(value_num, 6) + 0.0 AS value_num FROM signals
           QUALIFY source <> 'eia_860m' OR row_number() OVER (PARTITION BY segment, signal_name, source_id
                   ORDER BY CASE WHEN observed_at <= {_N} THEN 0 ELSE 1 END, observed_at DESC, ingested_at DESC) = 1""",
        "signals",
    ),
)
def dedupe_window_order(spark, sf_dir):
    df = T.dedupe_signals(store.signals(spark, sf_dir), order="window", as_of=NOW)
    return df.select("segment", "signal_name", "source_id", "observed_at", r6("value_num"))


@query(
    "f9_mode_filter",
    check(
        """SELECT segment, horizon, as_of, CAST(COUNT(*) AS BIGINT) AS n FROM (
             SELECT segment, horizon, as_of, CASE WHEN month(as_of) % 2 = 0 AND mode = 'fixed' THEN NULL ELSE mode END AS mode FROM hist)
           WHERE coalesce(mode, 'fixed') = 'fixed' GROUP BY ALL""",
        "hist",
    ),
)
def mode_filter(spark, sf_dir):
    history = store.score_history(spark, sf_dir).withColumn(
        "mode", F.when((F.month("as_of") % 2 == 0) & (F.col("mode") == "fixed"), None).otherwise(F.col("mode"))
    )
    return T.mode_filter(history, "fixed").groupBy("segment", "horizon", "as_of").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f5_on_day",
    """SELECT event_type, CAST(COUNT(*) AS BIGINT) AS n, round(SUM(CAST(value AS DECIMAL(18,2))), 2)::DOUBLE AS total
       FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' GROUP BY ALL""",
)
def on_day(spark, sf_dir):
    df = T.on_day(V.table(spark, sf_dir, "events"), "ts", dt.date(2024, 1, 10))
    return df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(V.money("value")).cast("double").alias("total")
    )


@query(
    "j1_asof_events",
    """SELECT p.event_id, p.user_id, round(s.value, 6) + 0.0 AS last_value, s.event_id AS last_event
       FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT user_id, ts, value, event_id FROM events WHERE event_type = 'view') s
         ON p.user_id = s.user_id AND p.ts >= s.ts""",
)
def asof_events(spark, sf_dir):
    """Raw events may pile up on one user, so the lookup runs in one-day slices."""
    events = V.table(spark, sf_dir, "events")
    probes = events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    views = events.filter(F.col("event_type") == "view").select(
        "user_id", "ts", F.col("value").alias("last_value"), F.col("event_id").alias("last_event")
    )
    hit = T.asof_join(probes, views, ["user_id"], "ts", "ts", ["last_value", "last_event"], slice_days=1)
    return hit.select("event_id", "user_id", r6("last_value"), "last_event")


@query(
    "j1_scores_asof",
    check("SELECT segment, t, round(b, 6) + 0.0 AS b, round(b_prime, 6) + 0.0 AS b_prime, regime FROM sc", "sc"),
)
def scores_asof(spark, sf_dir):
    from tidemark.operators.returns import scores_asof as lookup

    history = store.score_history(spark, sf_dir).filter("horizon = 'near' AND mode = 'fixed'")
    dates = grids.eval_dates(V.BACKTEST_START, V.BACKTEST_END)
    return lookup(history, store.universe(spark, sf_dir), dates).select("segment", "t", r6("b"), r6("b_prime"), "regime")


@query(
    "j2_close_asof",
    check(
        """SELECT p.ticker, p.t, x.date AS bar_date, x.close FROM (SELECT DISTINCT ticker, t FROM prices, evald) p
           ASOF LEFT JOIN prices x ON p.ticker = x.ticker AND p.t >= x.date""",
        "prices",
        "evald",
    ),
)
def close_asof(spark, sf_dir):
    from tidemark.operators.returns import close_asof as lookup
    from tidemark.operators.returns import universe_grid

    bars = store.prices(spark, sf_dir)
    probes = universe_grid(bars, grids.eval_dates(V.BACKTEST_START, V.BACKTEST_END))
    return lookup(probes, bars).select("ticker", "t", "bar_date", "close")


@query(
    "j17_previous_score",
    check(
        f"""SELECT segment, horizon, arg_max(as_of, as_of) AS as_of, round(arg_max(b, as_of), 6) + 0.0 AS b, arg_max(regime, as_of) AS regime
            FROM hist WHERE mode = 'fixed' AND as_of < {_N} GROUP BY ALL""",
        "hist",
    ),
)
def previous_score(spark, sf_dir):
    history = store.score_history(spark, sf_dir).filter("mode = 'fixed'")
    return T.previous_score(history, NOW).select("segment", "horizon", "as_of", r6("b"), "regime")


_SOURCES = """SELECT 'src' || n AS source, [1, 7, 28][n % 3 + 1] AS min_interval_days, ['daily', 'weekly', 'monthly'][n % 3 + 1] AS cadence
              FROM (SELECT DISTINCT CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS n FROM documents)"""


def _ledger(spark, sf_dir):
    """One run per document: newer for higher ids, every sixth one failed."""
    docs = V.table(spark, sf_dir, "documents")
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("doc_id") % 60).cast("int"))
    return docs.filter(F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 4 != 1).select(
        "source",
        day.cast("timestamp_ntz").alias("last_ingested_at"),
        F.when(F.col("doc_id") % 6 == 0, "ERROR").otherwise("OK").alias("status"),
    )


def _sources(spark, sf_dir):
    no = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    at = (no % 3 + 1).cast("int")
    return (
        V.table(spark, sf_dir, "documents")
        .select("source")
        .distinct()
        .select(
            "source",
            F.element_at(F.array(F.lit(1), F.lit(7), F.lit(28)), at).alias("min_interval_days"),
            F.element_at(F.array(F.lit("daily"), F.lit("weekly"), F.lit("monthly")), at).alias("cadence"),
        )
    )


@query(
    "j13_due_sources",
    f"""SELECT source, min_interval_days FROM ({_SOURCES}) s WHERE NOT EXISTS (
          SELECT 1 FROM (SELECT source AS src, max(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER)) AS last_ok FROM documents
                         WHERE doc_id % 6 <> 0 AND CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 4 <> 1 GROUP BY 1) l
          WHERE l.src = s.source AND l.last_ok + to_days(s.min_interval_days) > TIMESTAMP '2024-03-05 12:00:00')""",
)
def due_sources(spark, sf_dir):
    due = T.due_sources(_sources(spark, sf_dir), _ledger(spark, sf_dir), dt.datetime(2024, 3, 5, 12))
    return due.select("source", "min_interval_days")


@query(
    "j13_fetch_window",
    f"""SELECT source, CASE cadence WHEN 'weekly' THEN DATE '2024-03-05' - 14 WHEN 'monthly' THEN DATE '2024-02-01'
                       ELSE DATE '2024-03-05' - 730 END AS since, DATE '2024-03-05' AS until FROM ({_SOURCES})""",
)
def fetch_window(spark, sf_dir):
    window = T.fetch_window(dt.date(2024, 3, 5))
    return _sources(spark, sf_dir).select("source", window["since"].alias("since"), window["until"].alias("until"))


@query(
    "x12_eval_dates",
    check("SELECT ticker, CAST(COUNT(*) AS BIGINT) AS n, min(t) AS first_t, max(t) AS last_t FROM (SELECT DISTINCT ticker, t FROM universe, evald) GROUP BY ALL", "universe", "evald"),
)
def eval_dates(spark, sf_dir):
    from tidemark.operators.returns import universe_grid

    grid = universe_grid(store.universe(spark, sf_dir), grids.eval_dates(V.BACKTEST_START, V.BACKTEST_END))
    return grid.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(
    "x13_month_starts",
    """SELECT CAST(unnest(generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH)) AS DATE) AS as_of, o_orderpriority AS priority
       FROM (SELECT o_orderpriority, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY ALL)""",
)
def month_grid(spark, sf_dir):
    span = V.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi")
    )
    return span.select(F.explode(grids.month_starts(F.col("lo"), F.col("hi"))).alias("as_of"), F.col("o_orderpriority").alias("priority"))


@query(
    "x11_publication_lag",
    """SELECT CAST(date_trunc('month', o_orderdate) + INTERVAL 3 MONTH AS DATE) AS released_at, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY ALL""",
)
def publication_lag(spark, sf_dir):
    from tidemark.constants import PUBLICATION_LAG_MONTHS
    from tidemark.functions.coerce import published_after

    released = published_after(F.col("o_orderdate").cast("date"), PUBLICATION_LAG_MONTHS)
    return V.table(spark, sf_dir, "orders").groupBy(released.alias("released_at")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s25_prune_history",
    check(
        """SELECT mode, CAST(COUNT(*) AS BIGINT) AS n, min(as_of) AS first_at FROM hist WHERE as_of >= DATE '2001-12-01' - 1000 GROUP BY ALL""",
        "hist",
    ),
)
def prune_history(spark, sf_dir):
    """Written by month, pruned in place, read again."""
    from tidemark.session import scratch_path
    from tidemark.sources import tables

    path = scratch_path(spark, "pruned")
    tables.overwrite_months(store.score_history(spark, sf_dir), path, "as_of")
    tables.delete_expired(spark, path, V.GRID_END, days=1000)
    return spark.read.parquet(path).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.min("as_of").alias("first_at"))
