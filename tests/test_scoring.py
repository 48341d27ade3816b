"""Hand-computed cases of extractors, normalization, scores, momentum and regimes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.bands import map_to_band, winsor_band
from tidemark.functions.regimes import classify, fast_resolve
from tidemark.operators import extractors as X
from tidemark.operators import geo as G
from tidemark.operators import scoring as S

D = dt.date


def months(n, start=D(2022, 1, 1)):
    return [D(start.year + (start.month - 1 + i) // 12, (start.month - 1 + i) % 12 + 1, 1) for i in range(n)]


def signals(spark, rows):
    return spark.createDataFrame(rows, "segment string, signal_name string, value_num double, observed_at date, geography string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_forward_over_operating(spark):
    df = signals(
        spark,
        [
            ("p", "planned_capacity_mw", 2000.0, D(2027, 1, 1), None),
            ("p", "planned_capacity_mw", 3000.0, D(2027, 6, 1), None),
            ("p", "capacity_mw", 20000.0, D(2026, 1, 1), None),
            ("p", "capacity_mw", 15000.0, D(2025, 1, 1), None),
            ("q", "planned_capacity_mw", 1.0, D(2027, 1, 1), None),
        ],
    )
    got = {r.segment: r.ratio for r in X.forward_over_operating(df).collect()}
    assert got == {"p": 0.25, "q": None}


def test_growth_needs_thirteen_points(spark):
    rows = [("a", "x", 100.0 + i, m, None) for i, m in enumerate(months(13))]
    rows += [("b", "x", 100.0 + i, m, None) for i, m in enumerate(months(12))]
    got = {r.segment: r.growth for r in X.growth(signals(spark, rows), "x").collect()}
    assert got["a"] == pytest.approx(0.12) and got["b"] is None


def test_latest_with_minimum_points(spark):
    df = signals(spark, [("a", "ppi", 240.0, D(2024, 1, 1), None), ("a", "ppi", 250.0, D(2024, 2, 1), None), ("b", "ppi", 9.0, D(2024, 1, 1), None)])
    got = {r.segment: r.value for r in X.latest(df, "ppi", 2).collect()}
    assert got == {"a": 250.0, "b": None}


def test_pairing_respects_gap_and_clamps(spark):
    df = signals(
        spark,
        [
            ("s", "peak", 120.0, D(2024, 5, 1), "A"),
            ("s", "cap", 100.0, D(2024, 1, 1), "A"),
            ("s", "peak", 50.0, D(2024, 5, 1), "B"),
            ("s", "cap", 100.0, D(2024, 1, 1), "B"),
            ("s", "peak", 50.0, D(2024, 5, 1), "C"),
            ("s", "cap", 100.0, D(2020, 1, 1), "C"),
            ("s", "peak", 50.0, D(2024, 5, 1), "D"),
        ],
    )
    pairs = X.pair_latest(df, "peak", "cap", ["segment", "geography"])
    assert pairs.count() == 2
    assert one(X.mean_clamped_ratio(pairs, ["segment"])).ratio == pytest.approx(0.75)


@pytest.mark.parametrize(
    "values,expected",
    [([1.0] * 6, 0.0), ([1.0] * 5 + [2.0], 1.0), ([2.0] * 5 + [1.0], -1.0), ([1.0, 3.0] * 3 + [4.0], 2.0), ([1.0] * 5, None)],
)
def test_phrase_zscore(spark, values, expected):
    rows = [("s", "m", v, m, None) for v, m in zip(values, months(len(values)))]
    got = [r.z for r in X.phrase_zscore(signals(spark, rows), ["m"]).collect()]
    assert got == ([] if expected is None else [pytest.approx(expected)])


def test_ttm_shift(spark):
    df = spark.createDataFrame([("s", f"2024-Q{i}" if i < 5 else f"2025-Q{i - 4}", float(v)) for i, v in enumerate([10, 10, 10, 10, 20, 20], 1)], "segment string, quarter string, total double")
    assert one(X.ttm_shift(df, 1)).ratio == pytest.approx((60 - 50) / 50)
    assert one(X.ttm_shift(df, 4)).ratio is None


def test_hhi_single_region_and_floor(spark):
    df = spark.createDataFrame(
        [("one", "US", 5.0), ("two", "US", 50.0), ("two", "JP", 50.0), ("floor", "US", 97.0), ("floor", "JP", 3.0)],
        "segment string, region string, w double",
    )
    got = {r.segment: r.hhi for r in G.hhi(df, ["segment"], "region", "w").collect()}
    assert got == {"one": pytest.approx(1.0), "two": pytest.approx(0.5), "floor": pytest.approx(1.0)}


def test_region_override_by_ticker_then_name_then_exchange(spark):
    uni = spark.createDataFrame(
        [("T1", "NYSE", "A"), ("T2", "NYSE", "B"), ("T3", "TSE", "C"), ("T4", "XXX", "E"), ("ADR", "NYSE", "Big ADR")], "ticker string, exchange string, name string"
    )
    over = spark.createDataFrame(
        [("T1", "Korea", None), ("B", "Europe", None), ("ADR", "Korea", "BIG"), ("BIG", "Taiwan", None)], "key string, region string, parent string"
    )
    got = {r.ticker: (r.region, r.company_key) for r in G.assign_region(uni, over).collect()}
    assert got == {"T1": ("Korea", "T1"), "T2": ("Europe", "T2"), "T3": ("Japan", "T3"), "T4": (None, "T4"), "ADR": ("Taiwan", "BIG")}


@pytest.mark.parametrize("raw,lo,hi,want", [(250.0, 80.0, 350.0, 0.6296296), (80.0, 80.0, 350.0, 0.0), (400.0, 80.0, 350.0, 1.0), (1.0, 2.0, 2.0, 0.5)])
def test_map_to_band(spark, raw, lo, hi, want):
    row = one(spark.range(1).select(map_to_band(F.lit(raw), F.lit(lo), F.lit(hi)).alias("v")))
    assert row.v == pytest.approx(want)


def test_winsor_band_uses_index_quantiles(spark):
    values = [float(v) for v in range(1, 41)]
    row = one(spark.createDataFrame([(values,)], "h array<double>").select(winsor_band(F.col("h")).alias("b")))
    assert (row.b.lo_v, row.b.hi_v) == (values[int(40 * 0.05)], values[int(40 * 0.95)])
    flat = one(spark.createDataFrame([([3.0, 3.0],)], "h array<double>").select(winsor_band(F.col("h")).alias("b")))
    assert flat.b is None


def raw_rows(spark, rows):
    return spark.createDataFrame(rows, "segment string, as_of date, sub_score string, raw double, source_key string, seed_value double")


def test_normalize_fixed_seed_imputed_and_unknown_source(spark):
    at = D(2024, 1, 1)
    df = raw_rows(
        spark,
        [
            ("s", at, "lead_time_growth", 250.0, "transformers_ppi", 0.2),
            ("s", at, "regulatory_friction", 0.7, "seed", 0.7),
            ("s", at, "capacity_tightness", None, "imputed", None),
            ("s", at, "demand_signal", 0.25, "no_such_source", 0.2),
        ],
    )
    got = {r.sub_score: r for r in S.normalize(S.with_band(df), "fixed").collect()}
    assert got["lead_time_growth"].value == pytest.approx(0.6296296) and got["lead_time_growth"].source == "extractor"
    assert got["regulatory_friction"].value == 0.7 and got["regulatory_friction"].confidence == "low"
    assert got["capacity_tightness"].value == 0.5 and got["capacity_tightness"].imputed
    assert got["demand_signal"].value == 0.25


def test_rolling_falls_back_until_a_year_of_history(spark):
    rows = [("s", m, "capacity_tightness", float(i % 10), "comtrade_volume", None) for i, m in enumerate(months(30))]
    banded = S.with_band(raw_rows(spark, rows))
    got = S.normalize(S.rolling_band(banded, ["segment", "sub_score", "source_key"]), "rolling").orderBy("as_of").collect()
    assert got[5].mode_used == "fallback_to_fixed" and got[20].mode_used == "rolling"
    assert got[20].confidence == "medium" and got[29].confidence == "high"
    history = sorted(float(i % 10) for i in range(20))
    lo, hi = history[int(20 * 0.05)], history[int(20 * 0.95)]
    assert got[20].value == pytest.approx(min(1, max(0, (0.0 - lo) / (hi - lo))))


def test_score_completeness_and_seed_share(spark):
    rows = [("s", n, 0.5, "seed", False) for n in ("lead_time_growth", "geo_concentration", "regulatory_friction", "demand_signal")]
    rows.append(("s", "capacity_tightness", 0.5, "imputed", True))
    df = spark.createDataFrame(rows, "segment string, sub_score string, value double, source string, imputed boolean")
    got = {r.horizon: r for r in S.weighted_score(df, ["segment"]).collect()}
    assert got["near"].b == pytest.approx(50.0)
    assert got["near"].completeness == pytest.approx(0.65) and got["long"].completeness == pytest.approx(0.9)
    assert got["near"].seed_share == pytest.approx(0.65)


def test_momentum_median_window_and_edges(spark):
    rows = [("a", D(2024, 1, 1), 50.0), ("a", D(2024, 2, 1), 60.0), ("a", D(2024, 3, 1), 100.0), ("a", D(2024, 4, 1), 66.0), ("a", D(2025, 6, 1), 70.0)]
    rows += [("b", D(2024, 1, 1), 4.0), ("b", D(2024, 2, 1), 4.5), ("c", D(2024, 1, 1), 10.0), ("c", D(2024, 2, 1), 90.0)]
    df = spark.createDataFrame(rows, "segment string, as_of date, b double")
    got = {(r.segment, r.as_of): r.b_prime for r in S.momentum(df, ["segment"]).collect()}
    assert got[("a", D(2024, 1, 1))] == 0.0
    assert got[("a", D(2024, 4, 1))] == pytest.approx(10.0)
    assert got[("a", D(2025, 6, 1))] == 0.0
    assert got[("b", D(2024, 2, 1))] == 100.0
    assert got[("c", D(2024, 2, 1))] == 100.0


REGIME_CASES = [
    (70, 20, 1, "PEAKING"), (70, 19.99, 1, "PEAKED"), (70, 0, 1, "PEAKED"), (70, -0.01, 1, "RESOLVING"), (69.99, 30, 1, "EMERGING"),
    (0, 30, 1, "EMERGING"), (30, -15, 1, "RESOLVING"), (69.99, -15, 1, "RESOLVING"), (30, -14.99, 1, "STABLE"), (50, 29.99, 1, "STABLE"),
    (29.99, -15, 1, "RESOLVING_FROM_LOW"), (29.99, -14.99, 1, "STABLE"), (10, 0, 1, "STABLE"), (90, 50, 0.39, "NO_DATA"), (90, 50, 0.4, "PEAKING"),
]


def test_regime_boundaries(spark):
    df = spark.createDataFrame([(i, float(b), float(bp), float(c)) for i, (b, bp, c, _) in enumerate(REGIME_CASES)], "i int, b double, bp double, c double")
    got = {r.i: r.r for r in df.select("i", classify(F.col("b"), F.col("bp"), F.col("c")).alias("r")).collect()}
    assert [got[i] for i in range(len(REGIME_CASES))] == [c[-1] for c in REGIME_CASES]


def test_fast_resolve(spark):
    df = spark.createDataFrame([("RESOLVING", -51.0), ("RESOLVING", -50.0), ("STABLE", -80.0), ("RESOLVING", None)], "r string, bp double")
    assert [r.f for r in df.select(fast_resolve(F.col("r"), F.col("bp")).alias("f")).collect()] == [True, False, False, False]


def test_hhi_far_from_seed_reverts(spark):
    at = D(2024, 1, 1)
    grid = spark.createDataFrame([(s, at, "geo_concentration") for s in ("near", "far")] + [("near", at, "capacity_tightness")], "segment string, as_of date, sub_score string")
    picked = spark.createDataFrame([("near", at, "geo_concentration", 0.5, "hhi"), ("far", at, "geo_concentration", 0.9, "hhi")], "segment string, as_of date, sub_score string, raw double, source_key string")
    seed = spark.createDataFrame([("near", "geo_concentration", 0.3), ("far", "geo_concentration", 0.3)], "segment string, sub_score string, seed_value double")
    got = {(r.segment, r.sub_score): (r.raw, r.source_key) for r in S.with_seed(grid, picked, seed).collect()}
    assert got == {("near", "geo_concentration"): (0.5, "hhi"), ("far", "geo_concentration"): (0.3, "seed"), ("near", "capacity_tightness"): (None, "imputed")}


def brute_trailing(rows, t, days):
    return sorted(v for d, v in rows if v is not None and t - dt.timedelta(days=days) <= d < t)


def test_daily_windows_equal_sorted_frames(spark):
    """Ten years of days with gaps, ties, nulls and two rows on some days: the tree gives what sorting every frame gives."""
    rng = random.Random(6)
    start = D(2010, 1, 1)
    rows = [("a", start + dt.timedelta(days=i), rng.choice([None, 1.0, 2.5, rng.gauss(0, 9)])) for i in range(3650) if rng.random() < 0.9]
    rows += [("a", D(2012, 5, 5), 7.0), ("b", start, 3.0), ("b", D(2019, 1, 1), None), ("c", start, None)] + [("d", start + dt.timedelta(days=i), 4.0) for i in range(9)]
    df = spark.createDataFrame(rows, "s string, as_of date, raw double").withColumn("b", F.col("raw"))
    daily = S.trailing_median(S.rolling_band(df, ["s"], daily=True), ["s"], daily=True)
    plain = S.trailing_median(S.rolling_band(df, ["s"]), ["s"])
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, daily.select(plain.columns).collect())) == sorted(map(key, plain.collect()))
    series = [(d, v) for s, d, v in rows if s == "a"]
    for r in rng.sample(daily.filter("s = 'a'").collect(), 40):
        values = brute_trailing(series, r.as_of, S.ROLLING_DAYS)
        assert r.n == len(values) and (r.lo_v is None or r.lo_v == values[int(len(values) * 0.05)])


def test_a_tree_of_ranks_finds_every_order_statistic():
    from tidemark.operators.order_stats import Ranks

    rng, inside, tree = random.Random(7), [], Ranks(50)
    for _ in range(400):
        r = rng.randrange(50)
        if r in inside:
            inside.remove(r)
            tree.add(r, -1)
        else:
            inside.append(r)
            tree.add(r, 1)
        assert [tree.find(k) for k in range(len(inside))] == sorted(inside)


def test_a_daily_backfill_equals_single_runs(spark):
    """Every day of the backfill is what one run on that day gives, the days before it published; raw sub-scores too."""
    from tidemark.operators.geo import exposure_hhi
    from tidemark.plans import fixtures as V
    from tidemark.plans import scoring as C
    from tidemark.plans import store
    from tidemark.session import cut_lineage

    sf = "/root/testdata/sf0.001"
    first, last = D(2001, 8, 31), D(2001, 9, 1)
    parts = V.segments(spark, sf), V.seed(spark, sf), exposure_hhi(store.universe(spark, sf))
    raw_history, scores = (t(spark, sf).filter(F.col("as_of") < F.lit(first)) for t in (store.raw_subscores, store.score_history))
    raw = cut_lineage(C.raw_subscores_daily(store.signals(spark, sf), *parts, first, last))
    names = ["segment", "horizon", "mode", "as_of", "b", "base", "b_prime", "first_at", "confidence"]
    near = lambda x: round(x, 9) + 0.0 if isinstance(x, float) else x
    tell = lambda rows: sorted(repr([near(x) for x in r]) for r in rows)
    show = lambda df: tell(df.select(names).collect())
    whole = C.backfill(raw, raw_history, scores, first, last, "rolling")
    done = []
    for n in range((last - first).days + 1):
        day = first + dt.timedelta(days=n)
        today = C.raw_subscores_on(store.signals(spark, sf), *parts, day)
        assert tell(today.select(raw.columns).collect()) == tell(raw.filter(F.col("as_of") == F.lit(day)).collect())
        got = C.recompute(today, raw_history, scores, day, "rolling")
        done += show(got)
        raw_history = spark.createDataFrame(raw_history.select(today.columns).union(today).collect(), today.schema)
        kept = [c for c in scores.columns if c in got.columns]
        scores = spark.createDataFrame(scores.select(kept).union(got.select(kept)).collect(), scores.select(kept).schema)
    assert show(whole) == sorted(done)
