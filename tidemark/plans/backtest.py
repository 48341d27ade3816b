"""Walk-forward backtest over a score history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import STEP_DAYS
from tidemark.operators import inference as I
from tidemark.operators import reads as Q
from tidemark.operators import returns as R
from tidemark.operators import selection as P
from tidemark.operators import temporal as T
from tidemark.session import cut_lineage, written


def basket_entries(
    history: DataFrame, universe: DataFrame, prices: DataFrame, dates: Column, sector_neutral: bool = False
) -> DataFrame:
    """Weighted long, short and watchlist holdings at every evaluation date."""
    scores = R.scores_asof(history, universe, dates)
    picked = P.top_tickers(P.all_sides(scores), universe, prices)
    return P.entry_weights(picked, sector_neutral)


def run(
    history: DataFrame,
    universe: DataFrame,
    prices: DataFrame,
    dates: Column,
    forward: int,
    horizon: str = "near",
    mode: str = "fixed",
    step: int = STEP_DAYS,
    priced: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Evaluation points, scores, IC report, baskets with metrics and drawdown, thin-data dates.

    What feeds several branches is written to shared storage once. ``prices`` is read more than once and best a stored table.
    ``priced`` gives ``R.universe_returns`` of the same universe, dates and prices, if another mode's run needs them too.
    """
    chosen = written(T.mode_filter(history, mode).filter(history["horizon"] == horizon), "history")
    points = written(R.eval_points(universe, dates, chosen, prices, forward, returns=priced), "points")
    entries = written(basket_entries(chosen, universe, prices, dates), "entries")
    held = written(R.bars_of(entries, prices), "held")
    returns = written(R.forward_return(entries.select("ticker", "t"), held, forward), "returns")
    scores = written(R.scores_asof(chosen, universe, dates), "scores")
    return {
        "points": points,
        "scores": scores,
        "ic": I.ic_report(points, forward, step),
        "entries": entries,
        "metrics": R.basket_metrics(entries, returns, forward),
        "drawdown": R.max_drawdown(entries, returns, held, forward),
        "thin": Q.low_live_dates(scores),
    }


def _one(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """One row with all rows as an array of structs, in the order of their first columns."""
    first = [F.col(c) for c in order]
    entry = F.struct(*first, *(F.col(c) for c in rows.columns if c not in order))
    return rows.agg(F.array_sort(F.collect_list(entry)).alias(name))


def report(
    fixed: dict[str, DataFrame], rolling: dict[str, DataFrame], start: dt.date, end: dt.date, forward: int, horizon: str = "near", primary: str = "fixed"
) -> DataFrame:
    """One row, ``report``: the nested report of a run in both modes, ready for ``to_json``.

    ``fixed`` and ``rolling`` are what ``run`` gives over the same bars, universe and dates; ``primary`` is reported and the
    other compared with it. Sections are aggregated to one row each, bounded by segments and by dates times sides, and
    put side by side.
    """
    main = rolling if primary == "rolling" else fixed
    ic = cut_lineage(main["ic"])
    pooled = lambda ics: ics.filter(F.col("grp") == "ALL")
    overall = pooled(ic).agg(F.struct(*(F.max(c).alias(c) for c in ("n", "n_dates", "rho", "p", "ci_low", "ci_high"))).alias("overall"))
    per_segment = ic.filter(F.col("grp") != "ALL").select(F.col("grp").alias("segment"), "n", "rho", "p", "ci_low", "ci_high", "constant", "rejected")
    counts = per_segment.agg(F.count_if("constant").alias("n_constant"), F.count_if(~F.col("constant")).alias("n_evaluated"))
    held = main["entries"].groupBy("t", "side").agg(
        F.array_sort(F.collect_set("segment")).alias("segments"),
        F.array_sort(F.collect_list(F.struct("ticker", "weight"))).alias("holdings"),
    )
    baskets = held.join(main["metrics"].select("t", "side", "gross", "net", "vol", "hit_rate", "coverage"), ["t", "side"], "left")
    baskets = baskets.join(main["drawdown"].select("t", "side", "max_drawdown"), ["t", "side"], "left")
    per_pair = I.compare_scores(fixed["points"].groupBy("segment", "t").agg(F.count(F.lit(1)).alias("n")), fixed["scores"], rolling["scores"])
    sizes = [d["points"].agg(F.count(F.lit(1)).alias(f"{name}_points"), F.countDistinct("t").alias(f"{name}_dates")) for name, d in (("fixed", fixed), ("rolling", rolling))]
    overall_ics = [pooled(ic if d is main else d["ic"]).agg(F.max("rho").alias(f"{name}_ic")) for name, d in (("fixed", fixed), ("rolling", rolling))]
    out = overall
    for section in (
        counts, _one(per_segment, "per_segment", "segment"), _one(baskets, "baskets", "t", "side"), _one(per_pair, "per_pair", "segment"),
        _one(main["thin"], "thin_dates", "t"), *sizes, *overall_ics,
    ):
        out = out.crossJoin(section)
    comparison = F.struct("fixed_ic", "rolling_ic", "fixed_points", "rolling_points", F.col("per_pair").alias("per_segment"))
    head = (F.lit(v).alias(k) for k, v in {"horizon": horizon, "mode": primary, "forward_days": forward, "start": start, "end": end}.items())
    whole = F.struct(*head, F.col(f"{primary}_dates").alias("n_eval_dates"), F.col(f"{primary}_points").alias("n_eval_points"), "overall", "n_constant", "n_evaluated", "per_segment", "baskets", "thin_dates", comparison.alias("fixed_vs_rolling"))
    return out.select(whole.alias("report"))
