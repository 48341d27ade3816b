"""Streaming queries: events land as files and are replayed until everything is processed and settled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.oracles.views import check
from tidemark.plans import fixtures as V
from tidemark.plans.registry import query
from tidemark.session import lanes, scratch_path
from tidemark.streaming import clusters, intake


def _landed(rows: DataFrame, ts: str, name: str) -> str:
    """``rows`` as landed files in time order, and one heartbeat far enough behind them to settle all."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    rows.repartitionByRange(lanes(spark), ts).write.parquet(path)
    beat = rows.agg(F.max(ts).alias(ts)).select(*((F.col(ts) + F.expr("INTERVAL 1000 DAYS")).alias(ts) if c == ts else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    beat.write.mode("append").parquet(path)
    return path


def _drain(spark: SparkSession, path: str, schema, judge, name: str, kind: str) -> DataFrame:
    stream = judge(intake.read_files(spark, path, schema, files_per_batch=1000))
    out = scratch_path(spark, name)
    intake.append_to(stream, out, f"{out}_checkpoint").awaitTermination()
    return intake.appended(spark, out, stream.schema, kind)


@query(
    "r1_stream_intake",
    """SELECT event_type AS signal_name, CAST(COUNT(*) + COUNT(*) FILTER (event_id % 10 = 0 AND value <> 0) AS BIGINT) AS n,
              CAST(SUM(CAST(value AS DECIMAL(18,2))) + coalesce(SUM(CAST(value AS DECIMAL(18,2)) * 2) FILTER (event_id % 10 = 0 AND value <> 0), 0) AS DOUBLE) AS total
       FROM events GROUP BY ALL""",
)
def stream_intake(spark, sf_dir):
    """Each event arrives twice, every tenth once more with a revised value."""
    events = V.table(spark, sf_dir, "events")
    copies = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(1), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(1)))
    landed = events.select(
        F.lit("events").alias("source"),
        F.col("event_id").cast("string").alias("source_id"),
        F.lit("all").alias("segment"),
        F.col("event_type").alias("signal_name"),
        F.col("ts").cast("date").alias("observed_at"),
        F.col("ts").cast("timestamp").alias("ingested_at"),
        F.col("value"),
        F.explode(copies).alias("factor"),
    ).withColumn("value_num", F.col("value") * F.col("factor"))
    rows = landed.drop("value", "factor")
    kept = _drain(spark, _landed(rows, "ingested_at", "landed"), rows.schema, intake.drop_repeats, "intake", "kept")
    return kept.groupBy("signal_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value_num").cast("decimal(18,2)")).cast("double").alias("total")
    )


@query(
    "r2_stream_clusters",
    check(
        """SELECT ticker, day, CAST(n AS BIGINT) AS n FROM (
             SELECT d.ticker, d.day, (SELECT COUNT(DISTINCT insider) FROM purchases p WHERE p.ticker = d.ticker AND p.day BETWEEN d.day - 4 AND d.day) AS n,
                    (SELECT COUNT(DISTINCT insider) FROM purchases p WHERE p.ticker = d.ticker AND p.day BETWEEN d.day - 5 AND d.day - 1) AS before
             FROM (SELECT DISTINCT ticker, day FROM purchases) d) WHERE n >= 3 AND before < 3""",
        "purchases",
    ),
)
def stream_clusters(spark, sf_dir):
    """Alerts on all days; the events land as files, a last heartbeat settles the last days."""
    buys = (
        V.table(spark, sf_dir, "events")
        .filter(F.col("event_type") == "purchase")
        .select(F.get_json_object("props", "$.k").alias("ticker"), F.col("user_id").alias("insider"), F.col("ts").cast("timestamp").alias("ts"))
    )
    judge = lambda stream: clusters.stream_clusters(stream, days=5, k=3)
    return _drain(spark, _landed(buys, "ts", "landed"), buys.schema, judge, "alerts", "alert").select("ticker", "day", "n")
