"""Scoring chain, normalization, momentum and regime queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import regimes
from tidemark.functions.bands import map_to_band
from tidemark.operators import extractors as X
from tidemark.operators import geo as G
from tidemark.operators import scoring as S
from tidemark.oracles.views import check, check_daily, check_on
from tidemark.plans import fixtures as V
from tidemark.plans import scoring as C
from tidemark.plans import store
from tidemark.plans.catalog.common import big, r6
from tidemark.plans.registry import query
from tidemark.session import cut_lineage



def rr(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name or expr}"


_HIST = ["segment", "horizon", "mode", "as_of"]


@query(
    "flagship_monthly_regimes",
    check(
        f"""SELECT as_of, segment, horizon, {rr('b')}, {rr('b_prime')}, {rr('completeness')}, {rr('seed_share')}, regime,
                   CAST(row_number() OVER (PARTITION BY as_of, horizon ORDER BY b DESC, b_prime DESC, segment) AS BIGINT) AS rank
            FROM hist WHERE mode = 'fixed' AND regime NOT IN ('RESOLVING', 'RESOLVING_FROM_LOW', 'NO_DATA')""",
        "hist",
    ),
)
def flagship_monthly_regimes(spark, sf_dir):
    """Which segments are tight, in which regime, at every month: the chain from raw lines, nothing stored."""
    from tidemark.operators.ranks import row_numbers
    from tidemark.operators.selection import long_guard

    raw = C.raw_subscores(
        V.signals(spark, sf_dir),
        V.segments(spark, sf_dir),
        V.seed(spark, sf_dir),
        G.exposure_hhi(V.universe(spark, sf_dir)),
        V.GRID_START,
        V.GRID_END,
    )
    scores = long_guard(C.score_history(C.normalized(raw, "fixed")))
    shown = scores.select("as_of", "segment", "horizon", "b", "b_prime", "completeness", "seed_share", "regime")
    ranked = row_numbers(shown, ["as_of", "horizon"], [F.col("b").desc(), F.col("b_prime").desc(), F.col("segment").asc()])
    return ranked.select(
        "as_of", "segment", "horizon", r6("b"), r6("b_prime"), r6("completeness"), r6("seed_share"), "regime", big("rank")
    )


@query(
    "recompute_mid_month",
    check_on(
        "2001-06-17",
        f"""SELECT segment, horizon, mode, as_of, {rr('b')}, {rr('base')}, {rr('b_prime')}, {rr('completeness')}, first_at, confidence, regime
            FROM hist WHERE as_of = DATE '2001-06-17'""",
        "hist",
    ),
)
def recompute_mid_month(spark, sf_dir):
    """A daily run: one day against the stored sub-score and score histories, both modes."""
    day = dt.date(2001, 6, 17)
    raw = cut_lineage(
        C.raw_subscores_on(
            store.signals(spark, sf_dir), V.segments(spark, sf_dir), V.seed(spark, sf_dir), G.exposure_hhi(store.universe(spark, sf_dir)), day
        )
    )
    parts = [C.recompute(raw, store.raw_subscores(spark, sf_dir), store.score_history(spark, sf_dir), day, mode) for mode in ("fixed", "rolling")]
    return parts[0].unionByName(parts[1]).select(
        *_HIST, r6("b"), r6("base"), r6("b_prime"), r6("completeness"), "first_at", "confidence", "regime"
    )


QUARTER = dt.date(2001, 7, 1), dt.date(2001, 9, 30)


def _daily_raw(spark, sf_dir):
    parts = V.segments(spark, sf_dir), V.seed(spark, sf_dir), G.exposure_hhi(store.universe(spark, sf_dir))
    return C.raw_subscores_daily(store.signals(spark, sf_dir), *parts, *QUARTER)


@query(
    "f3_daily_raw_subscores",
    check_daily(*map(str, QUARTER), f"SELECT as_of, segment, sub_score, source_key, {rr('raw')} FROM rawsub WHERE as_of >= DATE '{QUARTER[0]}'", "rawsub"),
)
def daily_raw_subscores(spark, sf_dir):
    """Sub-scores of every day of a quarter, worked out at the dates on which something changes."""
    return _daily_raw(spark, sf_dir).select("as_of", "segment", "sub_score", "source_key", r6("raw"))


@query(
    "recompute_quarter_daily",
    check_daily(
        *map(str, QUARTER),
        f"""SELECT segment, horizon, mode, as_of, {rr('b')}, {rr('base')}, {rr('b_prime')}, {rr('completeness')}, confidence, CASE WHEN abs(b_prime) > 1e-9 THEN regime END AS regime
            FROM hist WHERE as_of >= DATE '{QUARTER[0]}'""",
        "hist",
    ),
)
def recompute_quarter_daily(spark, sf_dir):
    """A backfill of every day of a quarter behind the stored monthly histories, both modes.

    Where a score stays the same the momentum is zero but for the last bit of sums, whose sign decides the regime:
    no regime is shown there.
    """
    raw = cut_lineage(_daily_raw(spark, sf_dir))
    parts = [C.backfill(raw, store.raw_subscores(spark, sf_dir), store.score_history(spark, sf_dir), *QUARTER, mode) for mode in ("fixed", "rolling")]
    return parts[0].unionByName(parts[1]).select(*_HIST, r6("b"), r6("base"), r6("b_prime"), r6("completeness"), "confidence", F.when(F.abs("b_prime") > 1e-9, F.col("regime")).alias("regime"))


_DAILY = """h AS (SELECT p_brand AS segment, CAST(l_shipdate AS DATE) AS as_of, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS raw
                  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
            w AS (SELECT segment, as_of, list_sort(list(raw) OVER v) AS l, min(as_of) OVER v AS first, max(as_of) OVER v AS last, median(raw) OVER v AS base
                  FROM h WINDOW v AS (PARTITION BY segment ORDER BY as_of RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
            k AS (SELECT *, coalesce(len(l), 0) AS n, l[CAST(floor(len(l) * 0.05::DOUBLE) AS INTEGER) + 1] AS lo, l[least(CAST(floor(len(l) * 0.95::DOUBLE) AS INTEGER), len(l) - 1) + 1] AS hi FROM w)"""


@query(
    "w3_daily_band",
    f"""WITH {_DAILY} SELECT segment, as_of, CASE WHEN n >= 2 AND lo <> hi THEN lo END AS lo_v, CASE WHEN n >= 2 AND lo <> hi THEN hi END AS hi_v,
        CAST(n AS BIGINT) AS n, CAST(coalesce(date_diff('day', first, last), 0) AS BIGINT) AS span_days, {rr('base')} FROM k""",
)
def daily_band(spark, sf_dir):
    """Band and median of a year before each day, on the daily units of each segment."""
    lines, part = V.table(spark, sf_dir, "lineitem"), V.table(spark, sf_dir, "part")
    daily = (
        lines.join(part, lines["l_partkey"] == part["p_partkey"])
        .groupBy(F.col("p_brand").alias("segment"), F.col("l_shipdate").cast("date").alias("as_of"))
        .agg(F.sum(V.money("l_quantity")).cast("double").alias("raw"))
    )
    band = S.rolling_band(daily.withColumn("b", F.col("raw")), ["segment"], days=365, daily=True)
    both = S.trailing_median(band, ["segment"], days=365, daily=True)
    return both.select("segment", "as_of", "lo_v", "hi_v", big("n"), big("span_days"), r6("base"))


@query(
    "j6_with_seed",
    check(f"SELECT as_of, segment, sub_score, source_key, {rr('raw')}, {rr('seed_value')} FROM rawsub", "rawsub"),
)
def with_seed(spark, sf_dir):
    return store.raw_subscores(spark, sf_dir).select("as_of", "segment", "sub_score", "source_key", r6("raw"), r6("seed_value"))


@query(
    "j7_with_band",
    check(
        f"SELECT as_of, segment, sub_score, source_key, {rr('band_lo', 'band_min')}, {rr('band_hi', 'band_max')} FROM banded",
        "banded",
    ),
)
def with_band(spark, sf_dir):
    df = S.with_band(store.raw_subscores(spark, sf_dir))
    return df.select("as_of", "segment", "sub_score", "source_key", r6("band_min"), r6("band_max"))


_SUBS = f"""SELECT as_of, segment, sub_score, {rr('value')}, source, imputed, mode_used,
            CASE WHEN source IN ('imputed', 'seed') THEN 'low' WHEN mode_used = 'rolling' AND span_days < 730 THEN 'medium' ELSE 'high' END AS confidence
            FROM subs WHERE mode = """


@query("x2_x3_normalize_fixed", check(_SUBS + "'fixed'", "subs"))
def normalize_fixed(spark, sf_dir):
    df = store.subscores(spark, sf_dir, "fixed")
    return df.select("as_of", "segment", "sub_score", r6("value"), "source", "imputed", "mode_used", "confidence")


@query("x2_x3_normalize_rolling", check(_SUBS + "'rolling'", "subs"))
def normalize_rolling(spark, sf_dir):
    df = store.subscores(spark, sf_dir, "rolling")
    return df.select("as_of", "segment", "sub_score", r6("value"), "source", "imputed", "mode_used", "confidence")


@query(
    "x4_band_divergence",
    check(
        """SELECT sub_score, source_key, CAST(COUNT(*) AS BIGINT) AS n,
                  CAST(COUNT(*) FILTER (source_key <> 'seed' AND raw IS NOT NULL AND span_days >= 365 AND n >= 2 AND lo_v IS NOT NULL
                       AND (lo_v < band_lo / 2 OR hi_v > band_hi * 2)) AS BIGINT) AS n_divergent
           FROM rolled GROUP BY ALL""",
        "rolled",
    ),
)
def band_divergence(spark, sf_dir):
    df = store.subscores(spark, sf_dir, "rolling")
    return df.groupBy("sub_score", "source_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("band_diverges").alias("n_divergent")
    )


@query(
    "x1_map_to_band",
    check(
        f"""SELECT segment, month, round(CASE WHEN v <= 75 THEN 0.0 WHEN v >= 90 THEN 1.0 ELSE (v - 75) / 15 END, 6) + 0.0 AS value
            FROM (SELECT segment, month, units / n_lines * CAST(3.2 AS DOUBLE) AS v FROM monthly)""",
        "monthly",
    ),
)
def band_map(spark, sf_dir):
    raw = F.expr("units / n_lines * 3.2D")
    return V.monthly(spark, sf_dir).select(
        "segment", "month", r6(map_to_band(raw, F.lit(75.0), F.lit(90.0)), "value")
    )


@query(
    "a1_weighted_score",
    check(f"SELECT segment, as_of, horizon, mode, {rr('b')} FROM scored", "scored"),
)
def weighted_score(spark, sf_dir):
    both = store.subscores(spark, sf_dir, "fixed").unionByName(store.subscores(spark, sf_dir, "rolling"))
    return S.weighted_score(both, ["segment", "as_of", "mode"]).select("segment", "as_of", "horizon", "mode", r6("b"))


@query(
    "a2_completeness",
    check(f"SELECT segment, as_of, horizon, {rr('completeness')}, {rr('seed_share')} FROM scored WHERE mode = 'fixed'", "scored"),
)
def completeness(spark, sf_dir):
    df = S.weighted_score(store.subscores(spark, sf_dir), ["segment", "as_of"])
    return df.select("segment", "as_of", "horizon", r6("completeness"), r6("seed_share"))


@query(
    "a3_subscore_maps",
    check(
        """SELECT segment, as_of, string_agg(sub_score || '=' || CAST(CAST(round(value, 4) AS DECIMAL(12,4)) AS VARCHAR), ',' ORDER BY sub_score) AS sub_scores,
                  string_agg(sub_score || '=' || source || '/' || CAST(imputed AS VARCHAR), ',' ORDER BY sub_score) AS provenance
           FROM subs WHERE mode = 'fixed' GROUP BY ALL""",
        "subs",
    ),
)
def subscore_maps(spark, sf_dir):
    maps = S.subscore_maps(store.subscores(spark, sf_dir), ["segment", "as_of"])
    entry = lambda e, v: F.concat(e["key"], F.lit("="), v)
    values = F.transform(
        F.map_entries("sub_scores"), lambda e: entry(e, F.round(e["value"], 4).cast("decimal(12,4)").cast("string"))
    )
    origin = F.transform(
        F.map_entries("provenance"),
        lambda e: entry(e, F.concat_ws("/", e["value"]["source"], e["value"]["imputed"].cast("string"))),
    )
    return maps.select(
        "segment", "as_of", F.array_join(F.array_sort(values), ",").alias("sub_scores"), F.array_join(F.array_sort(origin), ",").alias("provenance")
    )


@query(
    "w1_w2_momentum",
    check(f"SELECT segment, horizon, mode, as_of, {rr('base')}, {rr('b_prime')} FROM hist", "hist"),
)
def momentum(spark, sf_dir):
    scored = store.score_history(spark, sf_dir).select(*_HIST, "b")
    return S.momentum(scored).select(*_HIST, r6("base"), r6("b_prime"))


@query(
    "w3_rolling_band",
    check(
        f"SELECT segment, sub_score, source_key, as_of, {rr('lo_v')}, {rr('hi_v')}, CAST(n AS BIGINT) AS n, CAST(span_days AS BIGINT) AS span_days FROM rolled",
        "rolled",
    ),
)
def rolling_band(spark, sf_dir):
    df = S.rolling_band(store.raw_subscores(spark, sf_dir), ["segment", "sub_score", "source_key"])
    return df.select("segment", "sub_score", "source_key", "as_of", r6("lo_v"), r6("hi_v"), big("n"), big("span_days"))


@query(
    "w9_history_span",
    check(
        """SELECT segment, sub_score, CAST(date_diff('day', min(as_of), max(as_of)) AS BIGINT) AS span_days, CAST(COUNT(*) AS BIGINT) AS n
           FROM rawsub WHERE raw IS NOT NULL GROUP BY ALL""",
        "rawsub",
    ),
)
def history_span(spark, sf_dir):
    df = S.history_span(store.raw_subscores(spark, sf_dir), ["segment", "sub_score"])
    return df.select("segment", "sub_score", big("span_days"), big("n"))


@query(
    "w10_age_confidence",
    check("SELECT segment, horizon, mode, as_of, first_at, confidence FROM hist", "hist"),
)
def age_confidence(spark, sf_dir):
    history = store.score_history(spark, sf_dir).select(*_HIST)
    return S.age_confidence(history).select(*_HIST, "first_at", "confidence")


@query(
    "x5_classify_regime",
    check(
        """SELECT segment, horizon, mode, as_of, regime, coalesce(regime = 'RESOLVING' AND b_prime < -50, false) AS fast_resolve FROM hist""",
        "hist",
    ),
)
def classify_regime(spark, sf_dir):
    history = store.score_history(spark, sf_dir).select(*_HIST, "b", "b_prime", "completeness")
    return S.with_regime(history).select(*_HIST, "regime", "fast_resolve")


@query(
    "x6_parse_regime",
    """SELECT label, CASE WHEN label IN ('PEAKING','PEAKED','RESOLVING','EMERGING','STABLE','RESOLVING_FROM_LOW','NO_DATA') THEN label ELSE 'NO_DATA' END AS regime,
              CAST(COUNT(*) AS BIGINT) AS n
       FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'PEAKING' WHEN 'F' THEN 'STABLE' ELSE 'LEGACY' END AS label FROM orders) GROUP BY ALL""",
)
def parse_regime(spark, sf_dir):
    label = F.when(F.col("o_orderstatus") == "O", "PEAKING").when(F.col("o_orderstatus") == "F", "STABLE").otherwise("LEGACY")
    return (
        V.table(spark, sf_dir, "orders")
        .select(label.alias("label"))
        .groupBy("label", regimes.parse_regime(F.col("label")).alias("regime"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "x7_pick_source",
    check("SELECT as_of, segment, sub_score, source_key, " + rr("raw") + " FROM live WHERE sub_score <> 'geo_concentration'", "live"),
)
def pick_source(spark, sf_dir):
    found = C.extracted(C.visible_points(store.signals(spark, sf_dir), V.GRID_START, V.GRID_END))
    picked = X.pick_source(C.candidates(found, V.segments(spark, sf_dir)), ["segment", "as_of"])
    return picked.select("as_of", "segment", "sub_score", "source_key", r6("raw"))


@query(
    "j5_pair_latest",
    check(
        f"""SELECT as_of, segment, geography, {rr('p', 'left_v')}, {rr('c', 'right_v')} FROM (
              SELECT as_of, segment, geography, max(v) FILTER (signal_name = 'iso_peak_load_mw') AS p, max(v) FILTER (signal_name = 'iso_capacity_mw') AS c,
                     max(seen_at) FILTER (signal_name = 'iso_peak_load_mw') AS pa, max(seen_at) FILTER (signal_name = 'iso_capacity_mw') AS ca
              FROM newest WHERE signal_name LIKE 'iso_%' GROUP BY ALL) WHERE c > 0 AND abs(date_diff('day', pa, ca)) <= 400""",
        "newest",
    ),
)
def pair_latest(spark, sf_dir):
    from tidemark.operators.temporal import visible_asof

    seen = visible_asof(store.signals(spark, sf_dir).filter(F.col("signal_name").startswith("iso_")), V.GRID_START, V.GRID_END)
    pairs = X.pair_latest(seen, "iso_peak_load_mw", "iso_capacity_mw", ["as_of", "segment", "geography"])
    return pairs.select("as_of", "segment", "geography", r6("left_v"), r6("right_v"))


@query("a6_mean_clamped_ratio", check(f"SELECT as_of, segment, {rr('raw', 'ratio')} FROM gridratio", "gridratio"))
def mean_clamped_ratio(spark, sf_dir):
    from tidemark.operators.temporal import visible_asof

    seen = visible_asof(store.signals(spark, sf_dir).filter(F.col("signal_name").startswith("iso_")), V.GRID_START, V.GRID_END)
    pairs = X.pair_latest(seen, "iso_peak_load_mw", "iso_capacity_mw", ["as_of", "segment", "geography"])
    return X.mean_clamped_ratio(pairs, ["as_of", "segment"]).select("as_of", "segment", r6("ratio"))



@query(
    "a7_forward_over_operating",
    check(
        """SELECT segment, round(SUM(value_num) FILTER (signal_name = 'planned_capacity_mw') / MAX(value_num) FILTER (signal_name = 'capacity_mw'), 6) + 0.0 AS ratio
           FROM signals WHERE signal_name IN ('planned_capacity_mw', 'capacity_mw') GROUP BY segment""",
        "signals",
    ),
)
def forward_over_operating(spark, sf_dir):
    return X.forward_over_operating(store.signals(spark, sf_dir)).select("segment", r6("ratio"))


@query(
    "a8_phrase_zscore",
    check(
        """SELECT segment, round(CASE WHEN hi = lo THEN sign(last - lo) ELSE (last - mean) / std END, 6) + 0.0 AS z FROM (
             SELECT segment, COUNT(*) AS n, MAX(v) FILTER (rn = 1) AS last, AVG(v) FILTER (rn > 1) AS mean, stddev_pop(v) FILTER (rn > 1) AS std,
                    MIN(v) FILTER (rn > 1) AS lo, MAX(v) FILTER (rn > 1) AS hi
             FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY m DESC) AS rn FROM (SELECT segment, observed_at AS m, SUM(value_num) AS v
                   FROM signals WHERE signal_name IN ('shortage_mentions', 'capacity_expansion_mentions') GROUP BY ALL))
             WHERE rn <= 12 GROUP BY ALL) WHERE n >= 6""",
        "signals",
    ),
)
def phrase_zscore(spark, sf_dir):
    df = X.phrase_zscore(store.signals(spark, sf_dir), ["shortage_mentions", "capacity_expansion_mentions"])
    return df.select("segment", r6("z"))


@query(
    "a9_quarterly_totals",
    check(
        """SELECT segment, quarter, CAST(SUM(v) AS DECIMAL(38,2)) AS total, CAST(COUNT(DISTINCT ticker) AS BIGINT) AS n_tickers,
                  quarter = MAX(quarter) OVER (PARTITION BY segment) AS is_latest FROM ledger GROUP BY segment, quarter""",
        "ledger",
    ),
)
def quarterly_totals(spark, sf_dir):
    quarterly = X.quarterly_totals(V.ledger(spark, sf_dir).withColumnRenamed("v", "value"))
    newest = X.latest_quarter(quarterly).select("segment", F.col("quarter").alias("last"))
    return quarterly.join(newest, "segment").select(
        "segment", "quarter", F.col("total").cast("decimal(38,2)").alias("total"), big("n_tickers"), (F.col("quarter") == F.col("last")).alias("is_latest")
    )


@query(
    "a10_ttm_shift",
    check(
        """SELECT segment, k, round((cur - prior) / prior, 6) + 0.0 AS ratio FROM (
             SELECT segment, k, SUM(v) FILTER (rn <= 4) AS cur, SUM(v) FILTER (rn > k AND rn <= k + 4) AS prior
             FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY quarter DESC) AS rn FROM (SELECT segment, quarter, CAST(SUM(v) AS DOUBLE) AS v FROM ledger GROUP BY ALL)),
                  (VALUES (1), (4)) ks(k) GROUP BY ALL)""",
        "ledger",
    ),
)
def ttm_shift(spark, sf_dir):
    quarterly = X.quarterly_totals(V.ledger(spark, sf_dir).select("segment", "ticker", "quarter", F.col("v").alias("value")))
    quarterly = quarterly.withColumn("total", F.col("total").cast("double"))
    one = X.ttm_shift(quarterly, 1).withColumn("k", F.lit(1))
    four = X.ttm_shift(quarterly, 4).withColumn("k", F.lit(4))
    return one.unionByName(four).select("segment", "k", r6("ratio"))


@query(
    "w7_growth",
    check(
        """SELECT segment, name, round((v - base) / base, 6) + 0.0 AS growth FROM (
             SELECT segment, signal_name AS name, value_num AS v, lag(value_num, 12) OVER w AS base, row_number() OVER (PARTITION BY segment, signal_name ORDER BY observed_at DESC) AS rn
             FROM signals WHERE signal_name IN ('industrial_production', 'ppi_semis', 'trade_volume')
             WINDOW w AS (PARTITION BY segment, signal_name ORDER BY observed_at)) WHERE rn = 1""",
        "signals",
    ),
)
def growth(spark, sf_dir):
    signals = store.signals(spark, sf_dir)
    parts = [
        X.growth(signals, name).select("segment", F.lit(name).alias("name"), r6("growth"))
        for name in ("industrial_production", "ppi_semis", "trade_volume")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "w8_latest",
    check(
        f"""SELECT segment, signal_name AS name, {rr('arg_max(value_num, observed_at)', 'value')} FROM signals
            WHERE signal_name IN ('capacity_utilization', 'ppi_transformers', 'book_to_bill_ratio') GROUP BY ALL""",
        "signals",
    ),
)
def latest(spark, sf_dir):
    signals = store.signals(spark, sf_dir)
    parts = [
        X.latest(signals, name, min_n).select("segment", F.lit(name).alias("name"), r6("value"))
        for name, min_n in (("capacity_utilization", 1), ("ppi_transformers", 2), ("book_to_bill_ratio", 1))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a4_hhi_exposure", check(f"SELECT segment, {rr('hhi')} FROM hhi", "hhi"))
def hhi_exposure(spark, sf_dir):
    return G.exposure_hhi(store.universe(spark, sf_dir)).select("segment", r6("hhi"))


@query(
    "a5_hhi_counts",
    check(
        """SELECT segment, round(SUM(w * w) / power(SUM(w), 2), 6) + 0.0 AS hhi
           FROM (SELECT segment, region, CAST(COUNT(*) AS DOUBLE) AS w FROM universe GROUP BY segment, region
                 QUALIFY COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY segment) >= 0.05)
           GROUP BY ALL""",
        "universe",
    ),
)
def hhi_counts(spark, sf_dir):
    return G.hhi_counts(store.universe(spark, sf_dir), ["segment"], "region").select("segment", r6("hhi"))


@query(
    "j8_assign_region",
    check(
        """SELECT ticker, segment, CASE WHEN CAST(ticker AS BIGINT) % 10 = 3 THEN 'HOLDING' ELSE ticker END AS company_key,
                  CASE WHEN CAST(ticker AS BIGINT) % 10 = 3 THEN 'Japan' WHEN CAST(ticker AS BIGINT) % 10 = 7 THEN 'Europe' ELSE region END AS region FROM universe""",
        "universe",
    ),
)
def assign_region(spark, sf_dir):
    uni = store.universe(spark, sf_dir)
    suppliers = V.table(spark, sf_dir, "supplier")
    by_ticker = suppliers.filter(F.col("s_suppkey") % 10 == 3).select(
        F.col("s_suppkey").cast("string").alias("key"), F.lit("Taiwan").alias("region"), F.lit("HOLDING").alias("parent")
    )
    by_name = suppliers.filter(F.col("s_suppkey") % 10 == 7).select(
        F.col("s_name").alias("key"), F.lit("Europe").alias("region"), F.lit(None).cast("string").alias("parent")
    )
    parent = spark.range(1).select(
        F.lit("HOLDING").alias("key"), F.lit("Japan").alias("region"), F.lit(None).cast("string").alias("parent")
    )
    homes = V.supplier_geo(spark, sf_dir).select(F.col("nation").alias("exchange"), "region").distinct()
    out = G.assign_region(uni.drop("region"), by_ticker.unionByName(by_name).unionByName(parent), homes)
    return out.select("ticker", "segment", "company_key", "region")
