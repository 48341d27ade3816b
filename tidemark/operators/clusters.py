"""Cluster buying: several distinct insiders inside a trailing window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import CLUSTER_DAYS, CLUSTER_THRESHOLD


def keep_latest_amendment(buys: DataFrame) -> DataFrame:
    """Highest accession per (ticker, insider, filing day)."""
    return buys.groupBy("ticker", "insider", "day").agg(F.max("accession").alias("accession"))


def cluster_events(buys: DataFrame, days: int = CLUSTER_DAYS, k: int = CLUSTER_THRESHOLD) -> DataFrame:
    """Filing days on which the distinct-insider count first reaches ``k``.

    Each insider covers [day, day + days - 1] after a buy. Overlapping covers are merged
    per insider, so an insider adds +1 where a cover starts and -1 where it ends, and the
    distinct count is a running sum of daily changes. Nothing larger than a list of days
    is held for any ticker or insider, and re-fires after a drop come out by themselves.
    """
    seen = buys.select("ticker", "insider", F.unix_date("day").alias("d")).distinct()
    per_insider = Window.partitionBy("ticker", "insider").orderBy("d")
    covers = seen.withColumn("prev", F.lag("d").over(per_insider)).withColumn("next", F.lead("d").over(per_insider))
    starts = F.col("prev").isNull() | (F.col("prev") + days < F.col("d"))
    ends = F.col("next").isNull() | (F.col("d") + days < F.col("next"))
    changes = (
        covers.select(
            "ticker",
            F.explode(
                F.array(
                    F.struct(F.col("d"), F.when(starts, 1).otherwise(0).alias("delta"), F.lit(1).alias("filed")),
                    F.struct((F.col("d") + days).alias("d"), F.when(ends, -1).otherwise(0).alias("delta"), F.lit(0).alias("filed")),
                )
            ).alias("c"),
        )
        .groupBy("ticker", F.col("c.d").alias("d"))
        .agg(F.sum("c.delta").alias("delta"), F.max("c.filed").alias("filed"))
    )
    upto = Window.partitionBy("ticker").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    counted = changes.withColumn("n", F.sum("delta").over(upto)).withColumn("before", F.col("n") - F.col("delta"))
    return counted.filter((F.col("filed") == 1) & (F.col("n") >= k) & (F.col("before") < k)).select(
        "ticker", F.date_from_unix_date(F.col("d").cast("int")).alias("day"), F.col("n").cast("long").alias("n")
    )
