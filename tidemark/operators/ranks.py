"""Exact ranks and cumulative counts without putting a group in one task.

One layout serves all of them. Rows are range-partitioned by (group, value, more columns) with bounds that
Spark draws from the data, so a group with a third of all rows, or values that crowd in one place, are
spread evenly over tasks. Each task counts inside its part. What lies in the tasks before it is one
small row per (group, task), accumulated and sent back. Repeated rows are merged with their count
before they are laid out (map-side combine first), so none of them is a hot key; a value that so
many different rows share that it crosses tasks has its count completed from the edges of those tasks.

A layout is written once to the shared folder with its task number, so bounds and counts stay the same
when a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: A row's number in its task and the task's number, as Spark's increasing ids hold them.
BITS = 33


def _laid_out(df: DataFrame, by: list[str], order: list[Column], cells: int | None) -> DataFrame:
    """``df`` sorted by (by, order) over tasks that hold about the same number of rows."""
    cells = cells or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in by] + order
    return df.repartitionByRange(cells, *keys).sortWithinPartitions(*keys)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with ``_least``, the weight of smaller values of the group in this task, and ``_upto``, with equal ones."""
    held: list[pa.RecordBatch] = []
    group, before = None, 0

    def runs(batch: pa.RecordBatch) -> np.ndarray:
        g, x = batch.column("_g").to_numpy(), batch.column("_x").to_numpy(zero_copy_only=False)
        return np.flatnonzero((g[1:] != g[:-1]) | ((x[1:] != x[:-1]) & ~((x[1:] != x[1:]) & (x[:-1] != x[:-1])))) + 1

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal group, before
        g, w = batch.column("_g").to_numpy(), batch.column("_w").to_numpy()
        heads = np.append(0, runs(batch))
        weight = np.add.reduceat(w, heads)
        total = np.cumsum(weight)
        new = np.append(g[0] != group, g[heads[1:]] != g[heads[:-1]])
        base = np.where(new, total - weight, 0)
        start = np.maximum.accumulate(np.where(new, np.arange(len(heads)), -1))
        least = np.where(start >= 0, total - weight - base[start], before + total - weight)
        group, before = g[-1], int(least[-1] + weight[-1])
        run = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(g))))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(least[run], pa.int64()), pa.array((least + weight)[run], pa.int64())], [*batch.schema.names, "_least", "_upto"])

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        return table.to_batches(max_chunksize=max(1, table.num_rows))[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and not len(runs(joined([held[-1].slice(held[-1].num_rows - 1), batch]))):
            held.append(batch)
            continue
        whole = joined([*held, batch])
        cut = runs(whole)
        if len(cut):
            yield counted(whole.slice(0, int(cut[-1])))
            whole = whole.slice(int(cut[-1]))
        held = [whole]
    if held:
        yield counted(joined(held))


def _counts(df: DataFrame, by: list[str], x: str, weight: str, spread: list[str], cells: int | None) -> DataFrame:
    """``df`` with ``_least`` and ``_upto`` of ``x`` over the whole group; ``weight`` says how many rows a row stands for.

    Rows must be told apart by (by, x, spread).
    """
    coded = df.withColumns({"_g": F.xxhash64(*by) if by else F.lit(0).cast("long"), "_x": F.col(x).cast("double"), "_w": F.col(weight).cast("long")})
    laid = _laid_out(coded, by, [F.col(x).asc(), *(F.col(c).asc() for c in spread)], cells)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema)
    inside = cut_lineage(laid.mapInArrow(_running, f"{ddl}, _least long, _upto long").withColumn("_cell", F.spark_partition_id()).drop("_g", "_x", "_w"))
    parts = inside.groupBy(*by, "_cell").agg(
        F.max("_upto").alias("_total"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.min("_upto").alias("_n_lo"), (F.max("_upto") - F.max("_least")).alias("_n_hi")
    )
    group = [F.col(c) for c in by] or [F.lit(0)]
    along = Window.partitionBy(*group).orderBy("_cell")
    one = F.col("_lo") == F.col("_hi")
    after = F.lag("_hi").over(along).eqNullSafe(F.col("_lo"))
    ahead = F.lead("_lo").over(along).eqNullSafe(F.col("_hi"))
    # the weight of a value over all tasks up to here (its last value) or from here on (its first value)
    back = Window.partitionBy(*group).orderBy(F.col("_cell").desc())
    parts = parts.withColumns({"_below": F.coalesce(F.sum("_total").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_after": after, "_ahead": ahead})
    parts = parts.withColumns({"_up": F.sum((~(one & F.col("_after"))).cast("int")).over(along), "_down": F.sum((~(one & F.col("_ahead"))).cast("int")).over(back)})
    up = Window.partitionBy(*group, "_up").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*group, "_down").orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumns({"_r": F.sum("_n_hi").over(up)}).withColumns({"_l": F.sum("_n_lo").over(down)})
    parts = parts.withColumns({"_before_lo": F.when(F.col("_after"), F.lag("_r").over(along)).otherwise(0), "_after_hi": F.when(F.col("_ahead"), F.lead("_l").over(along)).otherwise(0)})
    small = parts.select(*(F.col(c).alias(f"_o_{c}") for c in by), F.col("_cell").alias("_in_cell"), "_below", "_lo", "_hi", "_before_lo", "_after_hi")
    on = F.col("_cell") == F.col("_in_cell")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    least = F.col("_below") + F.col("_least") - F.when(F.col(x) == F.col("_lo"), F.col("_before_lo")).otherwise(0)
    upto = F.col("_below") + F.col("_upto") + F.when(F.col(x) == F.col("_hi"), F.col("_after_hi")).otherwise(0)
    return inside.join(small, on).select(*df.columns, least.alias("_least"), upto.alias("_upto"))


def cumulative_counts(df: DataFrame, by: list[str], x: str, cells: int | None = None) -> DataFrame:
    """(by, x, n, upto): ties of x, and rows of the group with value <= x. Null values are left out."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
    return _counts(counts, by, x, "n", [], cells).select(*by, x, "n", F.col("_upto").alias("upto"))


def average_ranks(df: DataFrame, by: list[str], cells: int | None = None, **names: str) -> DataFrame:
    """(by, values, n, ranks) of the distinct rows of (by, values): ``average_ranks(df, by, x="rank_of_x")``.

    ``n`` says how often a row occurs; ties share the mean rank. Values must not be null.
    """
    values = list(names)
    out = cut_lineage(df.groupBy(*by, *values).agg(F.count(F.lit(1)).alias("n")))
    ranked = out
    for x, name in names.items():
        # only the distinct values are laid out; a value has one rank, which its rows fetch by an equal key
        sizes = out.groupBy(*by, x).agg(F.sum("n").alias("n")) if len(values) > 1 else out
        rank = with_rank(sizes, by, x, name, "n", cells).select(*(F.col(c).alias(f"_o_{c}") for c in (*by, x)), name)
        on = F.lit(True)
        for c in (*by, x):
            on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
        ranked = ranked.join(rank, on).drop(*(f"_o_{c}" for c in (*by, x)))
    return ranked


def with_rank(df: DataFrame, by: list[str], x: str, name: str, weight: str, cells: int | None = None) -> DataFrame:
    """``df``, a row per (by, x) that stands for ``weight`` rows, with the mean rank of ``x`` among those of its group."""
    counted = _counts(df, by, x, weight, [], cells)
    return counted.select(*df.columns, ((F.col("_least") + 1 + F.col("_upto")) / 2.0).cast("double").alias(name))


def row_numbers(df: DataFrame, by: list[str], order: list[Column], name: str = "rank", cells: int | None = None) -> DataFrame:
    """``df`` with the number of each row of a group in ``order``, as a window over the whole group gives it.

    ``order`` should end in a key that tells the rows of a group apart; rows that it leaves equal share a task
    and are numbered in any order.
    """
    laid = cut_lineage(_laid_out(df, by, order, cells).withColumn("_id", F.monotonically_increasing_id()))
    laid = laid.withColumns({"_cell": F.shiftright("_id", BITS), "_at": F.col("_id").bitwiseAND(F.lit((1 << BITS) - 1))})
    group = [F.col(c) for c in by] or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_total"), F.min("_at").alias("_first"))
    below = F.coalesce(F.sum("_total").over(before), F.lit(0))
    small = parts.select(*(F.col(c).alias(f"_o_{c}") for c in by), F.col("_cell").alias("_in_cell"), (below - F.col("_first") + 1).alias("_add"))
    on = F.col("_cell") == F.col("_in_cell")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return laid.join(small, on).select(*df.columns, (F.col("_at") + F.col("_add")).cast("int").alias(name))
