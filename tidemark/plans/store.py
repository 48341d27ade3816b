"""Landed and published tables of one session.

Scoring, selection and backtest all start from stored tables (signals, prices, universe,
score history). Here they are derived from the given tables once per session and input
folder, written as Parquet to the shared folder, and read back with column pruning and
pushed filters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.geo import exposure_hhi
from tidemark.plans import fixtures as V
from tidemark.plans import scoring as C
from tidemark.session import scratch_path
from tidemark.sources.tables import latest_scores

_PATHS: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The named table, built and written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key in _PATHS:
        try:
            return spark.read.parquet(_PATHS[key])
        except AnalysisException:  # the shared folder was cleared: build again
            del _PATHS[key]
    path = scratch_path(spark, name)
    build().write.mode("overwrite").parquet(path)
    _PATHS[key] = path
    return spark.read.parquet(path)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "signals", lambda: V.signals(spark, sf_dir))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "prices", lambda: V.prices(spark, sf_dir))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "universe", lambda: V.universe(spark, sf_dir))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "edges", lambda: V.graph_edges(spark, sf_dir))


def raw_subscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return C.raw_subscores(
            signals(spark, sf_dir),
            V.segments(spark, sf_dir),
            V.seed(spark, sf_dir),
            exposure_hhi(universe(spark, sf_dir)),
            V.GRID_START,
            V.GRID_END,
        )

    return stored(spark, sf_dir, "raw_subscores", build)


def subscores(spark: SparkSession, sf_dir: str, mode: str = "fixed") -> DataFrame:
    return C.normalized(raw_subscores(spark, sf_dir), mode)


def score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both normalization modes, as the backtest reads them."""

    def build() -> DataFrame:
        both = subscores(spark, sf_dir, "fixed").unionByName(subscores(spark, sf_dir, "rolling"))
        return C.score_history(both)

    return stored(spark, sf_dir, "score_history", build)


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published snapshot: the newest row of each (segment, horizon, mode), with its first date."""
    return stored(spark, sf_dir, "snapshot", lambda: latest_scores(score_history(spark, sf_dir)))


def scores_on(spark: SparkSession, sf_dir: str, mode: str = "fixed") -> DataFrame:
    """The snapshot of the newest as-of date."""
    history = score_history(spark, sf_dir).filter(F.col("mode") == mode)
    return history.filter(F.col("as_of") == F.lit(V.GRID_END))
