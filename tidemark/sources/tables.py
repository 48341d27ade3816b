"""Sinks: signal table, score tables, histories, keyed merges, reports."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import RETENTION_DAYS
from tidemark.session import cut_lineage


def append_signals(signals: DataFrame, path: str, now: dt.datetime | None = None) -> None:
    """Stamp arrival and append; revisions are kept, nothing is merged on write."""
    stamp: Column = F.localtimestamp() if now is None else F.lit(now).cast("timestamp_ntz")
    (
        signals.withColumn("ingested_at", stamp)
        .withColumn("observed_month", F.trunc("observed_at", "month"))
        .hint("rebalance", "observed_month")
        .write.mode("append")
        .partitionBy("observed_month")
        .parquet(path)
    )


SCORE_KEYS = ("segment", "horizon", "mode", "as_of")
SUB_SCORE_KEYS = ("segment", "sub_score", "mode", "as_of")


def _paths(spark: SparkSession, path: str):
    """The file system of ``path`` and its path class, for listings and deletes on the driver."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _paths(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path``."""
    fs, at = _paths(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _paths(spark, path)
    fs.delete(at, True)


def overwrite_months(df: DataFrame, path: str, ts: str, month: str = "computed_month") -> None:
    """Replace only the months present in ``df``, whole."""
    (
        df.withColumn(month, F.trunc(ts, "month"))
        .hint("rebalance", month)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(month)
        .parquet(path)
    )


MONTH = "computed_month"
HISTORIES = {"score_history": SCORE_KEYS, "sub_score_history": SUB_SCORE_KEYS}


def _write(df: DataFrame, path: str, month: str | None = None) -> None:
    writer = df.write
    if month is not None:
        writer = df.hint("rebalance", month).write.partitionBy(month)
    writer.parquet(path)


def _commits(spark: SparkSession, root: str) -> list[str]:
    fs, at = _paths(spark, f"{root}/commits")
    names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    return [n for n in names if n.endswith(".json") and n[0] != "."]


def read_commit(spark: SparkSession, root: str, back: int = 0) -> dict:
    """The newest state, or one ``back`` steps before: its number, the snapshot's version, and per history the version that holds each month."""
    names = _commits(spark, root)
    if len(names) <= back:
        return {"number": -1, "scores": None, "score_history": {}, "sub_score_history": {}}
    path = f"{root}/commits/{names[-1 - back]}"
    fs, at = _paths(spark, path)
    stream = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, root: str, state: dict) -> None:
    """The one small file that makes a state the newest: written aside and renamed."""
    name = f"{state['number']:08d}.json"
    fs, aside = _paths(spark, f"{root}/commits/.{name}")
    stream = fs.create(aside, True)
    stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    stream.close()
    if not fs.rename(aside, _paths(spark, f"{root}/commits/{name}")[1]):
        raise RuntimeError(f"commit {name} exists already: another run has published")


def _versions(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    return [(t, int(v.split("=")[1])) for t in (*HISTORIES, "scores") for v in children(spark, f"{root}/{t}") if v.startswith("version=")]


def _clean(spark: SparkSession, root: str, keep: list[dict]) -> None:
    """Remove versions that no state of ``keep`` names: what a failed run left, or newer states have replaced."""
    used = {("scores", s["scores"]) for s in keep} | {(t, v) for s in keep for t in HISTORIES for v in s[t].values()}
    for table, version in _versions(spark, root):
        if (table, version) not in used:
            remove(spark, f"{root}/{table}/version={version:08d}")


def _read_months(spark: SparkSession, root: str, table: str, months: dict[str, int]) -> DataFrame:
    """Months of a history from the versions that hold them, each list of folders with its base, so months are columns."""
    parts = []
    for version in sorted(set(months.values())):
        base = f"{root}/{table}/version={version:08d}"
        mine = [m for m, v in months.items() if v == version]
        rows = spark.read.parquet(base).filter(F.col(MONTH).isin([dt.date.fromisoformat(m) for m in mine]))
        parts.append(rows)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_history(spark: SparkSession, root: str, table: str = "score_history") -> DataFrame:
    """A history as the newest commit has it, with ``computed_month``; filters on that prune folders."""
    return _read_months(spark, root, table, read_commit(spark, root)[table])


def read_scores(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot of the newest commit."""
    return spark.read.parquet(f"{root}/scores/version={read_commit(spark, root)['scores']:08d}")


def publish_scores(history: DataFrame, sub_history: DataFrame, root: str, retain_days: int | None = None, now: dt.date | None = None) -> None:
    """Both histories merged by key and the snapshot of the newest row per key, as one commit.

    Changed months are written whole into a new version, beside those that readers see; the commit file that names the
    version of every month and of the snapshot is written last. A run that dies before it leaves the former state, and
    the next run removes what it left. Only touched months are read and rewritten; the snapshot comes from the
    former one and the new rows. With ``retain_days`` the same commit drops expired months and days (S25). Versions of
    the state before stay for readers that are under way.
    """
    spark = history.sparkSession
    state = read_commit(spark, root)
    _clean(spark, root, [state, read_commit(spark, root, 1)])
    number = max([state["number"], *(v for _, v in _versions(spark, root))]) + 1
    after = {"number": number, "scores": number}
    first = None if retain_days is None else (now or dt.date.today()) - dt.timedelta(days=retain_days)
    for table, df in (("score_history", history), ("sub_score_history", sub_history)):
        months = dict(state[table])
        touched = {r[0].isoformat() for r in df.select(F.trunc("as_of", "month")).distinct().collect()}
        if first is not None:
            months = {m: v for m, v in months.items() if m >= first.replace(day=1).isoformat()}
            if first.day > 1 and first.replace(day=1).isoformat() in months:
                touched.add(first.replace(day=1).isoformat())
        old = {m: v for m, v in months.items() if m in touched}
        rows = df if not old else upsert(_read_months(spark, root, table, old).drop(MONTH), df, [k for k in HISTORIES[table] if k in df.columns])
        if first is not None:
            rows = rows.filter(F.col("as_of") >= F.lit(first))
        _write(rows.withColumn(MONTH, F.trunc("as_of", "month")), f"{root}/{table}/version={number:08d}", MONTH)
        held = {name.removeprefix(f"{MONTH}=") for name in children(spark, f"{root}/{table}/version={number:08d}")}
        after[table] = {m: v for m, v in months.items() if m not in touched} | dict.fromkeys(sorted(held & touched), number)
    rows = history
    if state["scores"] is not None:
        former = spark.read.parquet(f"{root}/scores/version={state['scores']:08d}")
        rerun = former.join(history.select(*SCORE_KEYS).distinct(), list(SCORE_KEYS), "left_anti")
        rows = rerun.unionByName(history)
    _write(latest_scores(rows), f"{root}/scores/version={number:08d}")
    _commit(spark, root, after)
    _clean(spark, root, [after, state])


def latest_scores(history: DataFrame) -> DataFrame:
    """One row per (segment, horizon, mode): the newest."""
    key = ["segment", "horizon", "mode"]
    payload = [c for c in history.columns if c not in key]
    return (
        history.groupBy(*key).agg(F.max_by(F.struct(*payload), "as_of").alias("r")).select(*key, "r.*")
    )


def prune(history: DataFrame, now: dt.date, days: int = RETENTION_DAYS, ts: str = "as_of", month: str = "computed_month") -> DataFrame:
    """S25 as a reader sees it: rows inside the retention window; the month bound reaches the partitions."""
    first = now - dt.timedelta(days=days)
    kept = history.filter(F.col(ts) >= F.lit(first))
    return kept.filter(F.col(month) >= F.lit(first.replace(day=1))) if month in history.columns else kept


def delete_expired(spark: SparkSession, path: str, now: dt.date, days: int = RETENTION_DAYS, ts: str = "as_of", month: str = "computed_month") -> None:
    """Delete what left the retention window: whole months as folders, the first kept month by rewriting it."""
    first = now - dt.timedelta(days=days)
    edge = first.replace(day=1)
    for name in children(spark, path):
        at = name.removeprefix(f"{month}=")
        if at != name and at < edge.isoformat():
            remove(spark, f"{path}/{name}")
    if exists(spark, f"{path}/{month}={edge.isoformat()}") and first > edge:
        rows = spark.read.parquet(path).filter(F.col(month) == F.lit(edge)).drop(month)
        kept = cut_lineage(rows.filter(F.col(ts) >= F.lit(first)))
        if kept.isEmpty():
            remove(spark, f"{path}/{month}={edge.isoformat()}")
        else:
            overwrite_months(kept, path, ts, month)


def record_run(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """J13, writing side: one row per source, the latest run wins with its status, rows written and detail."""
    newest = runs.groupBy("source").agg(F.max(F.struct("last_ingested_at", "status", "rows_written", "detail")).alias("r")).select("source", "r.*")
    return upsert(ledger, newest, ["source"])


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed merge, the new row wins."""
    payload = [c for c in existing.columns if c not in keys]
    both = existing.withColumn("_gen", F.lit(0)).unionByName(new.select(*existing.columns).withColumn("_gen", F.lit(1)))
    return (
        both.groupBy(*keys)
        .agg(F.max_by(F.struct(*payload), "_gen").alias("r"))
        .select(*keys, "r.*")
        .select(*existing.columns)
    )


def write_report(frames: dict[str, DataFrame], path: str) -> None:
    """Each part of a report as JSON lines under its own name."""
    for name, df in frames.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
