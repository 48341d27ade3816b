"""Rank correlation, block bootstrap, false-discovery control."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import BOOTSTRAP_SEED, BOOTSTRAPS, FDR_ALPHA
from tidemark.operators.ranks import cumulative_counts, with_rank
from tidemark.session import cut_lineage, written


def _same(keys: list[str]) -> Column:
    """Equal keys of a table and of one whose keys are renamed, nulls equal."""
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return on


def _renamed(df: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"_o_{c}") for c in keys), *more)


def spearman_by(points: DataFrame, group: list[str], x: str, y: str, min_n: int = 4) -> DataFrame:
    """Rank correlation per group; null below ``min_n`` points or without variance.

    Groups that can have none are told by their sizes and edges and never ranked. In the others the values of ``x``
    are ranked, pairs fetch that rank, and only the distinct values of ``y`` are laid out, each with the sum of
    the ranks it meets: sums over pairs are sums over these. So no row per pair is stored, and if ``x`` has
    few values (pass that variable as ``x``) the pairs are not shuffled before they are summed.
    """
    pairs = points.select(*group, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    usable = (F.count(F.lit(1)) >= min_n) & (F.min(x) != F.max(x)) & (F.min(y) != F.max(y))
    shape = written(pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), usable.alias("_usable")), "shape")
    live = pairs.join(_renamed(shape.filter("_usable"), group), _same(group), "left_semi")
    sizes = live.groupBy(*group, x).agg(F.count(F.lit(1)).alias("_n"))
    ranked = written(with_rank(sizes, group, x, "_rx", "_n"), "ranks")
    met = live.join(_renamed(ranked, [*group, x], "_rx"), _same([*group, x])).groupBy(*group, y)
    sums = with_rank(met.agg(F.count(F.lit(1)).alias("_n"), F.sum("_rx").alias("_sx")), group, y, "_ry", "_n")
    n, rx, ry = F.col("_n"), F.col("_rx"), F.col("_ry")
    squares = ranked.groupBy(*group).agg(F.sum(n).alias("_m"), F.sum(n * rx).alias("_tx"), F.sum(n * rx * rx).alias("_xx"))
    products = sums.groupBy(*group).agg(F.sum(n * ry).alias("_ty"), F.sum(n * ry * ry).alias("_yy"), F.sum(F.col("_sx") * ry).alias("_xy"))
    m, tx, ty = F.col("_m").cast("double"), F.col("_tx"), F.col("_ty")
    ic = (m * F.col("_xy") - tx * ty) / F.sqrt(m * F.col("_xx") - tx * tx) / F.sqrt(m * F.col("_yy") - ty * ty)
    both = squares.join(_renamed(products, group, "_ty", "_yy", "_xy"), _same(group)).select(*group, ic.alias("ic"))
    return shape.join(_renamed(both, group, "ic"), _same(group), "left").select(*group, "ic", "n")


def mean_ic(date_ics: DataFrame, group: list[str], min_dates: int = 2) -> DataFrame:
    """Mean over usable dates; null below ``min_dates``."""
    return date_ics.groupBy(*group).agg(
        F.when(F.count("ic") >= min_dates, F.avg("ic")).alias("mean_ic"), F.count("ic").alias("n_dates")
    )


def block_size(forward: int, step: int) -> int:
    if step <= 0:
        raise ValueError("step must be positive")
    return max(1, math.ceil(forward / step))


def block_bootstrap(
    date_ics: DataFrame,
    group: str,
    forward: int,
    step: int,
    reps: int = BOOTSTRAPS,
    seed: int = BOOTSTRAP_SEED,
    parts: int = 20,
) -> DataFrame:
    """Circular block bootstrap of the mean date IC.

    Only the calendar-bounded list of date ICs of a group is gathered. Block sums are
    taken once per start; replicates go to the tasks in ``parts`` per group, and each draws its
    blocks inside one array expression, so no row per draw is ever made. Block starts come from md5 of (seed,
    group, replicate, draw), so a rerun after a lost executor, or another engine, draws the same blocks.
    """
    size = block_size(forward, step)
    series = (
        date_ics.filter(F.col("ic").isNotNull())
        .groupBy(group)
        .agg(F.array_sort(F.collect_list(F.struct("t", "ic"))).alias("_s"))
        .withColumn("_n", F.size("_s"))
        .filter(F.col("_n") >= 2)
    )
    blocks = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda start: sum(F.element_at("_s", (start + o) % F.col("_n") + 1)["ic"] for o in range(size)),
    )
    spread = (
        series.select(group, "_n", blocks.alias("_blocks"))
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        .repartition(group, "_part")
        .withColumn("_rep", F.explode(F.filter(F.sequence(F.lit(1), F.lit(reps)), lambda r: r % parts == F.col("_part"))))
    )

    def drawn(total: Column, draw: Column) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group), F.col("_rep"), draw))
        start = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.col("_n")
        return total + F.element_at("_blocks", (start + 1).cast("int"))

    whole = F.aggregate(F.sequence(F.lit(1), F.col("_n")), F.lit(0.0), drawn)
    means = spread.select(group, (whole / (F.col("_n") * size)).alias("_m"))
    edges = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975)))
    below = F.avg((F.col("_m") <= 0).cast("double"))
    above = F.avg((F.col("_m") >= 0).cast("double"))
    return means.groupBy(group).agg(
        F.element_at(edges, 1).alias("ci_low"),
        F.element_at(edges, 2).alias("ci_high"),
        F.stddev_samp("_m").alias("std"),
        F.greatest(2.0 * F.least(below, above), F.lit(1.0 / reps)).alias("p"),
    )


def benjamini_hochberg(df: DataFrame, p_col: str, alpha: float = FDR_ALPHA) -> DataFrame:
    """Reject every p at or below the largest one that passes k * alpha / m.

    k is the count of p-values not above p, which gives ties one verdict. Equal p-values
    are merged and the others counted in tasks of equal size, so no task sees all hypotheses.
    Null counts as 1.
    """
    whole = df.withColumn("_p", F.coalesce(F.col(p_col), F.lit(1.0)).cast("double"))
    ranked = cut_lineage(cumulative_counts(whole, [], "_p"))
    m = ranked.agg(F.max("upto").alias("_m"))
    bar = (
        ranked.join(F.broadcast(m), F.lit(True))
        .filter(F.col("_p") <= F.col("upto") * alpha / F.col("_m"))
        .agg(F.max("_p").alias("_bar"))
    )
    return (
        whole.join(F.broadcast(bar), F.lit(True))
        .withColumn("rejected", F.coalesce(F.col("_p") <= F.col("_bar"), F.lit(False)))
        .select(*df.columns, "rejected")
    )


def ic_report(points: DataFrame, forward: int, step: int, group: str = "segment", reps: int = BOOTSTRAPS) -> DataFrame:
    """Per group and pooled (``ALL``) IC with interval, p and verdict.

    Groups whose score never changes get no IC and are marked constant. The pooled row
    takes no part in the false-discovery family.
    """
    per_group = points.select(F.col(group).cast("string").alias("grp"), "t", "b", "ret")
    pooled = per_group.withColumn("grp", F.lit("ALL"))
    both = per_group.unionByName(pooled)
    shape = both.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), ((F.min("b") == F.max("b")) & (F.col("grp") != "ALL")).alias("constant")
    )
    ics = cut_lineage(spearman_by(both, ["grp", "t"], "b", "ret"))
    center = mean_ic(ics, ["grp"])
    spread = block_bootstrap(ics, "grp", forward, step, reps)
    rows = shape.join(center, "grp", "left").join(spread, "grp", "left")
    live = ~F.col("constant")
    rows = rows.select(
        "grp",
        "n",
        F.when(live, F.col("mean_ic")).alias("rho"),
        *[F.when(live, F.col(c)).alias(c) for c in ("p", "ci_low", "ci_high")],
        "n_dates",
        "constant",
    )
    rows = cut_lineage(rows)
    family = benjamini_hochberg(rows.filter(F.col("grp") != "ALL"), "p")
    return family.unionByName(rows.filter(F.col("grp") == "ALL").withColumn("rejected", F.lit(False)))


def pair_modes(points_a: DataFrame, points_b: DataFrame) -> DataFrame:
    """The same evaluation point under two modes; keys are unique first."""
    key = ["segment", "t", "ticker"]

    def side(points: DataFrame, tag: str) -> DataFrame:
        return points.dropDuplicates(key).select(
            *key, F.col("b").alias(f"b_{tag}"), F.col("regime").alias(f"regime_{tag}")
        )

    return side(points_a, "a").join(side(points_b, "b"), key)


def compare_modes(paired: DataFrame) -> DataFrame:
    """Mean absolute score difference and regime flips per segment."""
    return paired.groupBy("segment").agg(
        F.avg(F.abs(F.col("b_a") - F.col("b_b"))).alias("mean_abs_diff"),
        F.count_if(F.col("regime_a") != F.col("regime_b")).alias("flips"),
        F.count(F.lit(1)).alias("n"),
    )


def compare_scores(sizes: DataFrame, scores_a: DataFrame, scores_b: DataFrame) -> DataFrame:
    """A18 where the points of one (segment, t) share their score: ``compare_modes`` weighted by ``sizes``.

    ``sizes`` is (segment, t, n), the points of the first mode; the second has the same ones wherever it has a score.
    """
    other = scores_b.select("segment", "t", F.col("b").alias("_b"), F.col("regime").alias("_regime"))
    n = F.col("n")
    return sizes.join(scores_a.select("segment", "t", "b", "regime"), ["segment", "t"]).join(other, ["segment", "t"]).groupBy("segment").agg(
        (F.sum(n * F.abs(F.col("b") - F.col("_b"))) / F.sum(n)).alias("mean_abs_diff"),
        F.coalesce(F.sum(F.when(F.col("regime") != F.col("_regime"), n)), F.lit(0)).alias("flips"),
        F.sum(n).alias("n"),
    )


def calibration_rank(ic: DataFrame) -> DataFrame:
    """Worst calibrated first; small samples weigh in lightly."""
    score = -F.col("rho") + F.greatest(F.lit(0), 20 - F.col("n")) / 100.0
    return ic.filter(F.col("rho").isNotNull()).select("segment", "n", "rho", score.alias("score")).orderBy(
        F.col("score").desc(), "segment"
    )
