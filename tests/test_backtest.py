"""Selection, returns, rank statistics and inference."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import grids
from tidemark.operators import inference as I
from tidemark.operators import ranks as K
from tidemark.operators import returns as R
from tidemark.operators import selection as P

D = dt.date
T0 = D(2024, 1, 1)


def scores(spark, rows):
    return spark.createDataFrame([(T0, *r) for r in rows], "t date, segment string, b double, b_prime double, regime string")


def chosen(df):
    return [r.segment for r in df.orderBy("rank").collect()]


def test_long_segments_guard_floor_and_proximity(spark):
    df = scores(spark, [("a", 90.0, 1.0, "PEAKED"), ("b", 79.0, 1.0, "PEAKED"), ("c", 95.0, -20.0, "RESOLVING"), ("d", 40.0, 0.0, "STABLE"), ("e", 99.0, 0.0, "NO_DATA")])
    assert chosen(P.top_segments(df, "long")) == ["a"]
    close = scores(spark, [("a", 90.0, 1.0, "PEAKED"), ("b", 80.0, 1.0, "PEAKED"), ("c", 80.0, 5.0, "STABLE")])
    assert chosen(P.top_segments(close, "long")) == ["a", "c"]


def test_short_segments_rank_by_product(spark):
    df = scores(spark, [("a", 80.0, -20.0, "RESOLVING"), ("b", 60.0, -30.0, "RESOLVING"), ("c", 90.0, -1.0, "STABLE"), ("d", 49.0, -90.0, "RESOLVING")])
    assert chosen(P.top_segments(df, "short")) == ["b"]


def test_watchlist_has_no_proximity_rule(spark):
    df = scores(spark, [("a", 90.0, 1.0, "PEAKED"), ("b", 55.0, 40.0, "EMERGING"), ("c", 52.0, 40.0, "EMERGING"), ("d", 99.0, 1.0, "PEAKING")])
    assert chosen(P.top_segments(df, "watchlist")) == ["a", "b"]


def test_top_tickers_once_per_basket_and_listing_gate(spark):
    segs = spark.createDataFrame([(T0, "long", "a", 1, 80.0), (T0, "long", "b", 2, 75.0)], "t date, side string, segment string, rank int, b double")
    uni = [(f"T{i}", f"n{i}", "a", 0.5 + i / 100, 3e9) for i in range(8)] + [("T7", "n7", "b", 0.9, 3e9), ("LATE", "l", "a", 0.99, 3e9), ("SMALL", "s", "a", 0.99, 1e9), ("LOW", "x", "a", 0.49, 3e9)]
    universe = spark.createDataFrame(uni, "ticker string, name string, segment string, exposure double, mcap double")
    bars = spark.createDataFrame([(f"T{i}", T0, 1.0) for i in range(8)] + [("LATE", D(2024, 2, 1), 1.0)], "ticker string, date date, close double")
    got = P.top_tickers(segs, universe, bars).collect()
    assert sorted((r.ticker, r.segment) for r in got) == [("T3", "a"), ("T4", "a"), ("T5", "a"), ("T6", "a"), ("T7", "b")]
    weights = {r.ticker: r.weight for r in P.entry_weights(P.top_tickers(segs, universe, bars), sector_neutral=True).collect()}
    assert weights == {"T3": 0.125, "T4": 0.125, "T5": 0.125, "T6": 0.125, "T7": 0.5}


def prices(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def test_forward_return_edges(spark):
    bars = prices(spark, [("A", D(2023, 12, 30), 100.0), ("A", D(2024, 3, 30), 110.0), ("B", D(2023, 12, 1), 50.0), ("C", D(2024, 2, 1), 5.0), ("Z", D(2023, 12, 1), 0.0), ("Z", D(2024, 2, 1), 1.0)])
    probes = spark.createDataFrame([(t, T0) for t in "ABCZ"], "ticker string, t date")
    got = {r.ticker: r.ret for r in R.forward_return(probes, bars, 90).collect()}
    assert got == {"A": pytest.approx(0.1), "B": None, "C": None, "Z": None}
    full = {r.ticker: r.ret for r in R.forward_return(probes, bars, 90, require_complete=True).collect()}
    assert full["A"] is None


def entries(spark, rows):
    return spark.createDataFrame([(T0, "long", *r) for r in rows], "t date, side string, ticker string, weight double")


def test_basket_metrics_cost_counts_unpriced_names(spark):
    held = entries(spark, [("A", 1 / 3), ("B", 1 / 3), ("C", 1 / 3)])
    rets = spark.createDataFrame([("A", T0, 0.2), ("B", T0, -0.1), ("C", T0, None)], "ticker string, t date, ret double")
    m = R.basket_metrics(held, rets, 90).collect()[0]
    assert m.gross == pytest.approx(0.05) and m.net == pytest.approx(0.05 - 0.003)
    assert m.hit_rate == 0.5 and m.coverage == pytest.approx(2 / 3)
    assert m.vol == pytest.approx(np.std([0.2, -0.1], ddof=1) * (252 / 90) ** 0.5)


def test_max_drawdown_on_common_dates(spark):
    days = [D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 3), D(2024, 1, 4)]
    bars = prices(spark, [("A", d, c) for d, c in zip(days, (100.0, 120.0, 90.0, 130.0))] + [("B", d, c) for d, c in zip(days, (10.0, 12.0, 9.0, 13.0)) if d != days[1]])
    held = entries(spark, [("A", 0.5), ("B", 0.5)])
    rets = R.forward_return(held.select("ticker", "t"), bars, 90)
    dd = R.max_drawdown(held, rets, bars, 90).collect()[0]
    assert dd.n_dates == 3 and dd.max_drawdown == pytest.approx(-0.1)
    assert {r.date for r in R.common_dates(held.select("t", "side", "ticker"), bars, ["t", "side"], 90).collect()} == {days[0], days[2], days[3]}


def test_basket_curve_keeps_dates_of_missing_returns(spark):
    m = spark.createDataFrame([(D(2024, 1, 1), "long", 0.1), (D(2024, 2, 1), "long", None), (D(2024, 3, 1), "long", -0.5), (D(2024, 4, 1), "long", -1.0)], "t date, side string, gross double")
    got = [(r.t.month, round(r.cumulative, 9)) for r in R.basket_curve(m, "long").orderBy("t").collect()]
    assert got == [(1, 1.1), (3, 0.55), (4, 0.0)]


def average_rank(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def test_ranks_match_brute_force_with_a_hot_value(spark):
    rng = random.Random(11)
    values = [rng.choice([0.0, 0.0, 0.0, -3.5, 1e-9, 2e6, rng.uniform(-1, 1)]) for _ in range(300)]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, x double")
    for cells in (1, 5, 40):
        # with ``i`` beside it the hot value is many rows that cross tasks, without it one merged row
        got = {r.i: r.rk for r in K.average_ranks(df, ["g"], cells, x="rk", i="by_i").collect()}
        assert [got[i] for i in range(300)] == average_rank(values)
        merged = {r.x: (r.n, r.rk) for r in K.average_ranks(df, ["g"], cells, x="rk").collect()}
        assert merged == {v: (values.count(v), r) for v, r in zip(values, average_rank(values))}


def test_counts_and_row_numbers_over_many_groups_and_tasks(spark):
    rng = random.Random(12)
    rows = [(rng.choice([None, "hot", "hot", "hot", "a", "b"]), i, rng.choice([None, 1.0, 1.0, rng.uniform(0, 9), float("nan")])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, x double")
    size = lambda v: (v != v, v if v == v else 0.0)
    for cells in (1, 7, 60):
        got = {(r.g, repr(r.x)): (r.n, r.upto) for r in K.cumulative_counts(df, ["g"], "x", cells).collect()}
        want = {}
        for g, _, x in rows:
            if x is not None:
                mine = [v for k, _, v in rows if k == g and v is not None]
                want[g, repr(x)] = (sum(size(v) == size(x) for v in mine), sum(size(v) <= size(x) for v in mine))
        assert got == want
        numbered = K.row_numbers(df.select("g", "i"), ["g"], [F.col("i").desc()], cells=cells).collect()
        assert {(r.g, r.i): r["rank"] for r in numbered} == {(g, i): sum(k == g and j >= i for k, j, _ in rows) for g, i, _ in rows}
        whole = {r.i: r["rank"] for r in K.row_numbers(df.select("i"), [], [F.col("i").asc()], cells=cells).collect()}
        assert whole == {i: i + 1 for i in range(400)}


def test_no_task_of_a_layout_holds_much_more_than_its_share(spark):
    """A third of the rows share one value, another third one group."""
    rows = [("hot", 5.0, i) for i in range(3000)] + [("hot", float(i), i) for i in range(3000)] + [(f"g{i % 50}", float(i), i) for i in range(3000)]
    laid = K._laid_out(spark.createDataFrame(rows, "g string, x double, i int"), ["g"], [F.col("x").asc(), F.col("i").asc()], 16)
    sizes = [r["count"] for r in laid.withColumn("cell", F.spark_partition_id()).groupBy("cell").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 3 * 9000 / 16


def ic_points(spark, rows):
    return spark.createDataFrame(rows, "t date, b double, ret double")


def test_spearman_against_numpy_and_degenerate_dates(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for m in range(1, 7):
        xs = [float(rng.randrange(8)) for _ in range(30)]
        ys = [x + rng.gauss(0, 3) for x in xs]
        rows += [(D(2024, m, 1), x, y) for x, y in zip(xs, ys)]
        want[D(2024, m, 1)] = np.corrcoef(average_rank(xs), average_rank(ys))[0, 1]
    rows += [(D(2025, 1, 1), 1.0, float(i)) for i in range(9)] + [(D(2025, 2, 1), float(i), float(i)) for i in range(3)]
    got = {r.t: r.ic for r in I.spearman_by(ic_points(spark, rows), ["t"], "b", "ret").collect()}
    assert got.pop(D(2025, 1, 1)) is None and got.pop(D(2025, 2, 1)) is None
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    twice = {r.t: r.ic for r in I.spearman_by(ic_points(spark, rows + rows), ["t"], "b", "ret").collect()}
    assert all(twice[k] == pytest.approx(v) for k, v in want.items())


def date_ics(spark, values, grp="g"):
    return spark.createDataFrame([(grp, D(2020, 1, 1) + dt.timedelta(days=30 * i), v) for i, v in enumerate(values)], "grp string, t date, ic double")


def test_block_bootstrap_properties(spark):
    assert I.block_size(90, 30) == 3 and I.block_size(30, 30) == 1 and I.block_size(10, 30) == 1
    up = [0.2 + 0.05 * (-1) ** i for i in range(24)]
    df = date_ics(spark, up).unionByName(date_ics(spark, [(-1.0) ** i * 0.3 for i in range(24)], "zero")).unionByName(date_ics(spark, [0.5], "short"))
    run = lambda: {r.grp: r for r in I.block_bootstrap(df, "grp", 90, 30, reps=400).collect()}
    a, b = run(), run()
    assert a == b and "short" not in a
    assert a["g"].ci_low <= np.mean(up) <= a["g"].ci_high and a["g"].p == pytest.approx(1 / 400)
    assert a["zero"].p > 0.5 and 0 < a["g"].std < 0.05


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.20), ("d", 0.50), ("e", None)], "k string, p double")
    assert {r.k for r in I.benjamini_hochberg(df.filter("k <> 'e'"), "p").filter("rejected").collect()} == {"a", "b"}
    assert {r.k for r in I.benjamini_hochberg(df, "p").filter("rejected").collect()} == {"a", "b"}
    none = spark.createDataFrame([("a", 0.9), ("b", None)], "k string, p double")
    assert I.benjamini_hochberg(none, "p").filter("rejected").count() == 0


def test_positive_signal_end_to_end(spark):
    """Faster drift for the tighter segment gives a clearly positive pooled IC."""
    days = [D(2023, 1, 1) + dt.timedelta(days=i) for i in range(700)]
    bars, uni = [], []
    for i in range(8):
        drift = 0.001 if i < 4 else 0.0003
        uni.append((f"T{i}", "hot" if i < 4 else "cold"))
        bars += [(f"T{i}", d, 100.0 * (1 + drift + i * 1e-6) ** n) for n, d in enumerate(days)]
    history = spark.createDataFrame([(s, d, b, 0.0, "STABLE") for s, b in (("hot", 90.0), ("cold", 30.0)) for d in days[::30]], "segment string, as_of date, b double, b_prime double, regime string")
    universe = spark.createDataFrame(uni, "ticker string, segment string")
    points = R.eval_points(universe, grids.eval_dates(D(2023, 3, 1), D(2024, 6, 1)), history, prices(spark, bars), 90)
    report = {r.grp: r for r in I.ic_report(points, 90, 30, reps=200).collect()}
    assert report["ALL"].rho > 0.3 and report["ALL"].p <= 0.01 and report["ALL"].ci_low > 0
    assert report["hot"].constant and report["hot"].rho is None and not report["hot"].rejected


def test_modes_compare(spark):
    a = spark.createDataFrame([("s", T0, "A", 50.0, "STABLE"), ("s", T0, "B", 60.0, "STABLE")], "segment string, t date, ticker string, b double, regime string")
    b = spark.createDataFrame([("s", T0, "A", 54.0, "PEAKED"), ("s", T0, "C", 60.0, "STABLE")], "segment string, t date, ticker string, b double, regime string")
    r = I.compare_modes(I.pair_modes(a, b)).collect()[0]
    assert (r.mean_abs_diff, r.flips, r.n) == (4.0, 1, 1)


def test_eval_grid_is_inclusive(spark):
    got = [r.t for r in grids.as_frame(spark, grids.eval_dates(D(2024, 1, 1), D(2024, 3, 1))).orderBy("t").collect()]
    assert got == [D(2024, 1, 1), D(2024, 1, 31), D(2024, 3, 1)]
    assert grids.as_frame(spark, grids.eval_dates(D(2024, 2, 1), D(2024, 1, 1))).count() == 0


def test_only_distinct_values_are_laid_out_for_ranks(spark, monkeypatch):
    """Before, every different pair was laid out twice: 200 rows here for 10 and 20 values."""
    df = spark.range(200).select((F.col("id") % 10).cast("double").alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y"))
    seen, plain = [], K._counts
    monkeypatch.setattr(K, "_counts", lambda rows, *rest: seen.append(rows.count()) or plain(rows, *rest))
    got = {(r.x, r.y): (r.rx, r.ry) for r in K.average_ranks(df, [], x="rx", y="ry").collect()}
    assert seen == [10, 20] and got[(0.0, 0.0)] == (10.5, 5.5) and got[(9.0, 19.0)] == (190.5, 195.5)


def test_returns_of_holdings_read_only_their_bars(spark):
    bars = spark.createDataFrame([(k, dt.date(2024, 1, 1) + dt.timedelta(days=d), float(d + 1)) for k in "abc" for d in range(3)], "ticker string, date date, close double")
    held = spark.createDataFrame([("a", dt.date(2024, 1, 1)), ("a", dt.date(2024, 1, 2))], "ticker string, t date")
    few = R.bars_of(held, bars)
    assert few.count() == 3 and R.forward_return(held, few, 1).exceptAll(R.forward_return(held, bars, 1)).isEmpty()


def two_modes(spark):
    days = [D(2023, 1, 1) + dt.timedelta(days=i) for i in range(0, 700, 7)]
    bars = prices(spark, [(f"T{i}", d, 100.0 + (i * 37 + n * n * 11) % 29) for i in range(6) for n, d in enumerate(days) if i or n > 60])
    universe = spark.createDataFrame([(f"T{i}", s) for i in range(6) for s in "abc" if (i + ord(s)) % 3] * 2, "ticker string, segment string")
    ddl = "segment string, as_of date, b double, b_prime double, regime string"
    one = spark.createDataFrame([(s, d, 40.0 + ord(s) % 7 + d.month, 0.0, "STABLE") for s in "ab" for d in days[::4]], ddl)
    other = spark.createDataFrame([(s, d, 50.0 + d.day % 5, 0.0, "PEAKED" if d.month % 2 else "STABLE") for s in "bc" for d in days[30::5]] + [("a", days[60], 9.0, 0.0, "STABLE")], ddl)
    return universe, bars, one, other, grids.eval_dates(D(2023, 3, 1), D(2024, 6, 1))


def test_paired_points_equal_paired_modes_and_find_returns_once(spark, monkeypatch):
    universe, bars, one, other, dates = two_modes(spark)
    want = I.pair_modes(*(R.eval_points(universe, dates, h, bars, 90) for h in (one, other)))
    calls, plain = [], R.forward_return
    monkeypatch.setattr(R, "forward_return", lambda *a, **k: calls.append(1) or plain(*a, **k))
    got = R.paired_points(universe, dates, one, other, bars, 90)
    assert len(calls) == 1 and got.columns == want.columns and got.count() == want.count() > 20
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("name", ["j14_pair_modes", "u2_common_keys", "a18_compare_modes"])
def test_mode_queries_build_no_points(spark, monkeypatch, name):
    """Before, the points of both modes were stored and then matched by key."""
    from tidemark.plans import catalog, registry

    catalog.load()

    def refuse(*a, **k):
        raise AssertionError("points built")

    monkeypatch.setattr(R, "eval_points", refuse)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001") is not None


def test_points_are_not_shuffled_to_meet_their_scores(spark):
    """The small table's size is known, although it comes from a large one; before, its plan's guess decided."""
    universe, bars, one, _, dates = two_modes(spark)
    wide = spark.range(1 << 21).filter("id < 0").select(F.lit("T0").alias("ticker"), F.lit("a").alias("segment")).unionByName(universe)
    points = R.eval_points(wide, dates, one, bars, 90)
    joins = [line for line in points._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join [segment" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)


def test_correlation_lays_out_distinct_values_of_groups_that_have_one(spark, monkeypatch):
    """Before, every pair was stored and joined to two ranks, also those of groups without variance."""
    rows = [("live", float(i % 10), float(i // 10)) for i in range(200)] + [("flat", 7.0, float(i)) for i in range(300)] + [("few", float(i), float(i)) for i in range(3)]
    rows += [(None, float(i % 5), float((i * 7) % 11)) for i in range(60)] + [("live", None, 1.0), ("live", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    seen, plain = [], K._counts
    monkeypatch.setattr(K, "_counts", lambda part, *rest: seen.append(part.count()) or plain(part, *rest))
    got = {r.g: (r.n, r.ic) for r in I.spearman_by(df, ["g"], "x", "y").collect()}
    assert seen == [10 + 5, 20 + 11]
    assert {g: n for g, (n, _) in got.items()} == {"live": 200, "flat": 300, "few": 3, None: 60} and got["flat"][1] is None and got["few"][1] is None
    for g in ("live", None):
        xs, ys = zip(*[(x, y) for k, x, y in rows if k == g and None not in (x, y)])
        assert got[g][1] == pytest.approx(np.corrcoef(average_rank(list(xs)), average_rank(list(ys)))[0, 1], abs=1e-12)


def test_report_compares_scores_and_runs_share_returns(spark, monkeypatch):
    """Before, each mode found all returns, and the points of both were matched by key."""
    from tidemark.plans import backtest as B

    universe, bars, one, other, dates = two_modes(spark)
    points = [R.eval_points(universe, dates, h, bars, 90) for h in (one, other)]
    want = {r.segment: (r.mean_abs_diff, r.flips, r.n) for r in I.compare_modes(I.pair_modes(*points)).collect()}
    named = universe.select("*", F.col("ticker").alias("name"), F.lit(0.9).alias("exposure"), F.lit(3e9).alias("mcap")).distinct()
    both = one.withColumn("mode", F.lit("fixed")).unionByName(other.withColumn("mode", F.lit("rolling"))).withColumn("horizon", F.lit("near"))
    priced = R.universe_returns(universe, dates, bars, 90)
    monkeypatch.setattr(R, "universe_returns", None)
    monkeypatch.setattr(I, "pair_modes", None)
    runs = [B.run(both, named, bars, dates, 90, mode=mode, priced=priced) for mode in ("fixed", "rolling")]
    row = B.report(*runs, D(2023, 3, 1), D(2024, 6, 1), 90).collect()[0].report
    got = {r.segment: (r.mean_abs_diff, r.flips, r.n) for r in row.fixed_vs_rolling.per_segment}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
    assert row.n_eval_points == points[0].count() and row.fixed_vs_rolling.rolling_points == points[1].count()
