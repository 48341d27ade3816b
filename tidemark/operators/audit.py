"""Daily divergence audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.constants import CLAIM_ABS_TOL, CLAIM_REL_TOL, DIVERGENCE_GAP, INTERESTING_MOMENTUM, INTERESTING_SCORE_DELTA, SEED_BACKED
from tidemark.functions.claims import claimed_values, tolerance_bucket


def divergences(subscores: DataFrame, by: list[str], gap: float = DIVERGENCE_GAP) -> DataFrame:
    """Seed-backed sub-scores whose value strayed from the seed.

    ``subscores`` has (by, sub_score, value, seed_value). One row per group with at least
    one divergence; at most three entries each.
    """
    d = F.col("value") - F.col("seed_value")
    entry = F.struct(
        "sub_score", F.col("seed_value").alias("seed"), F.col("value").alias("dynamic"), d.alias("gap")
    )
    return (
        subscores.filter(F.col("sub_score").isin(*SEED_BACKED) & (F.abs(d) > gap))
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(entry)).alias("divergences"))
    )


def flag_interesting(
    scores: DataFrame,
    prev: DataFrame,
    diverged: DataFrame,
    dscore: float = INTERESTING_SCORE_DELTA,
    dmom: float = INTERESTING_MOMENTUM,
) -> DataFrame:
    """diverged, moving, new, or changed by more than the threshold."""
    before = prev.select("segment", "horizon", F.col("b").alias("prev_b"), F.lit(True).alias("_had"))
    out = scores.join(before, ["segment", "horizon"], "left").join(
        diverged.select("segment", "divergences"), "segment", "left"
    )
    changed = F.abs(F.col("b") - F.col("prev_b")) > dscore
    moving = F.abs(F.col("b_prime")) > dmom
    interesting = (
        F.col("divergences").isNotNull()
        | F.coalesce(moving, F.lit(False))
        | F.col("_had").isNull()
        | F.coalesce(changed, F.lit(False))
    )
    return out.withColumn("interesting", interesting).drop("_had")


def divergence_report(diverged: DataFrame) -> DataFrame:
    """JSON per segment:horizon, only where something diverged."""
    return diverged.filter(F.size("divergences") > 0).select(
        F.concat_ws(":", "segment", "horizon").alias("key"), F.to_json("divergences").alias("payload")
    )


def run_counts(snapshots: DataFrame) -> DataFrame:
    """Snapshots by how they were produced."""
    return snapshots.groupBy("generated_by").agg(F.count(F.lit(1)).alias("n"))


def grounding_values(
    scores: DataFrame, previous: DataFrame, subscores: DataFrame, seed: DataFrame, diverged: DataFrame, signals: DataFrame
) -> DataFrame:
    """(segment, horizon, value), distinct: every number that a rationale of a segment and horizon may cite.

    The score and momentum of the horizon and its previous score; of the segment the sub-scores, seeds, divergences
    (seed, dynamic, gap), shown signals and the years and months of their dates.
    """
    per_horizon = scores.select("segment", "horizon", F.explode(F.array("b", "b_prime")).alias("value"))
    per_horizon = per_horizon.unionByName(previous.select("segment", "horizon", F.col("b").alias("value")))
    gaps = diverged.select("segment", F.explode("divergences").alias("d")).select("segment", F.explode(F.array("d.seed", "d.dynamic", "d.gap")).alias("value"))
    day = F.col("observed_at")
    shown = signals.select("segment", F.explode(F.array(F.col("value_num"), F.year(day).cast("double"), F.month(day).cast("double"))).alias("value"))
    per_segment = (
        subscores.select("segment", "value").unionByName(seed.select("segment", F.col("seed_value").alias("value"))).unionByName(gaps).unionByName(shown).distinct()
    )
    both = per_horizon.unionByName(scores.select("segment", "horizon").distinct().join(per_segment, "segment").select("segment", "horizon", "value"))
    return both.filter(F.col("value").isNotNull() & ~F.isnan("value")).distinct()


def ungrounded_claims(texts: DataFrame, known: DataFrame, key: list[str], by: list[str], text: str = "text") -> DataFrame:
    """(key, by, at, claim): claimed numbers of ``texts`` that no ``known`` value of their ``by`` backs; ``at`` counts a text's numbers.

    Known values are held by tolerance bucket, one row with the values of three neighbouring buckets, so a claim meets
    only values near it, whatever the size of the set. ``key`` tells texts apart.
    """
    near = F.explode(F.array(*(F.col("_b") + i for i in (-1, 0, 1)))).alias("_bucket")
    index = known.withColumn("_b", tolerance_bucket(F.col("value"))).select(*by, "value", near).groupBy(*by, "_bucket").agg(F.collect_set("value").alias("_known"))
    claims = texts.select(*key, *by, F.posexplode(claimed_values(F.col(text))).alias("at", "_c")).select(*key, *by, "at", F.col("_c.claim").alias("claim"), F.explode("_c.values").alias("_v"))
    met = claims.withColumn("_bucket", tolerance_bucket(F.col("_v"))).join(index, [*by, "_bucket"], "left")
    backed = F.exists("_known", lambda k: F.abs(F.col("_v") - k) <= F.greatest(F.lit(CLAIM_ABS_TOL), F.lit(CLAIM_REL_TOL) * F.abs(k)))
    judged = met.groupBy(*key, *by, "at", "claim").agg(F.max(F.coalesce(backed, F.lit(False))).alias("_backed"))
    return judged.filter(~F.col("_backed")).drop("_backed")
