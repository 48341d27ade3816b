"""Session helpers: defaults for local runs, lineage cuts, shared scratch paths."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "tidemark", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster, set to a local default only if unset."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = f"/tmp/tidemark-{uuid.uuid4().hex[:8]}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return (configured or sc.getCheckpointDir()).rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a plan that several branches read once, on storage that outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lanes(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for tables handed from one job to the next."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``cut_lineage`` as Parquet: compressed, read by column, and of a size that Spark knows when it plans a join.

    A checkpoint keeps the size guessed for its plan, so a table of a few hundred rows that comes from
    large ones is never broadcast, and the large side of its join is shuffled for nothing.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table planned as a local relation: no job, no Python worker."""
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    names = [name for name, _ in fields]

    def literal(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{value!r}D" if isinstance(value, float) else str(value)

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS v({', '.join(names)})")
