"""Mixing sources to target weights.

Tokens are summed per source, each source's target gives its repetition rate, and a document is
emitted floor(rate) times plus once more with the fraction as its probability, drawn from a hash of
(seed, doc_id, text), so that reruns agree and documents without doc_ids of their own draw apart.

Rows: a null text has size 0; a null source is a source of its own, ordered last; a source without
words has target 0 and its documents are not emitted; rows that repeat doc_id and text draw alike; an
empty table gives no rows. ``documents`` columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import WORD, lanes, stored

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 17


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ordered_sources(sums: DataFrame) -> DataFrame:
    """Add ``place``, the source's rank by code point (null last), without one task that sees all sources.

    Range partitions are stored with their number; their counts, one row per partition, give each its offset.
    """
    order = F.asc_nulls_last("source")
    ranged = stored(sums.repartitionByRange(lanes(sums.sparkSession), order).withColumn("shard", F.spark_partition_id()), "sources")
    offset, offsets = 0, {}
    for shard, n in sorted((r["shard"], r["n"]) for r in ranged.groupBy("shard").agg(F.count("*").alias("n")).collect()):
        offsets[shard] = offset
        offset += n
    if not offsets:
        return ranged.withColumn("place", F.lit(0).cast("long"))
    start = F.element_at(F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)), F.col("shard"))
    return ranged.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy(order)) - 1 + start)


def targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``: shares by weight of all sizes, at most ``most`` times a source's size.

    The excess goes to the others by weight until none is above: target = min(most * size, level * weight).
    Only the level is worked out on the driver, from one row of sums a round.
    """
    place = ordered_sources(sums)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    rows = stored(place.select("source", "source_size", weight.alias("weight")), "weights")
    full = F.col("source_size") * most
    level, above = 0.0, -1
    while True:
        over = full < F.col("weight") * F.lit(level)
        total, capped, free, n = rows.agg(F.sum("source_size"), F.sum(F.when(over, full).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if n == above or not total:
            break
        above = n
        if not free:
            break
        level = (total - capped) / free
    return rows.select("source", "source_size", F.least(full.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def _unit(seed: int) -> Column:
    """A number in [0, 1) from a hash of the seed, doc_id and text."""
    text = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` of every row. Texts are read once."""
    sized = stored(docs.select("doc_id", "source", size_of().alias("size"), _unit(seed).alias("unit")), "sizes")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    joined = sized.join(goal.withColumnRenamed("source", "__mix_source"), F.col("source").eqNullSafe(F.col("__mix_source"))).drop("__mix_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return joined.withColumn("copies", (F.floor(rate) + F.when(F.col("unit") < rate - F.floor(rate), 1).otherwise(0)).cast("int")).drop("unit")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every document as often as its rate says, in its own columns."""
    goal = stored(rates(docs, weights, most, seed).select("source", "source_size", "target").distinct(), "goals")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.select(F.col("source").alias("__mix_source"), rate.alias("__mix_rate"))
    joined = docs.join(goal, docs["source"].eqNullSafe(goal["__mix_source"]))
    copies = F.floor("__mix_rate") + F.when(_unit(seed) < F.col("__mix_rate") - F.floor("__mix_rate"), 1).otherwise(0)
    return joined.withColumn("__mix_copies", copies.cast("int")).filter("__mix_copies > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*docs.columns)


def op4_query(docs: DataFrame) -> DataFrame:
    mixed = rates(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(md5(text), '') AS th, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM sums),
level(round, share) AS (
  SELECT 0, 0::DOUBLE
  UNION ALL
  SELECT round + 1, (SELECT (sum(source_size) - sum(CASE WHEN 3 * source_size < weight * share THEN 3 * source_size ELSE 0 END))::DOUBLE
                          / sum(CASE WHEN 3 * source_size < weight * share THEN 0 ELSE weight END) FROM placed)
  FROM level WHERE round < 40),
goal AS (SELECT source, source_size, least(3 * source_size::DOUBLE, weight * (SELECT share FROM level ORDER BY round DESC LIMIT 1)) AS target FROM placed),
drawn AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || th), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS unit
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN unit < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM drawn
"""
