"""Order statistics of trailing windows, at logarithmic cost per row.

For daily histories a frame holds thousands of values; sorting it again for every row costs their number times
the number of rows. Here every series is walked once in time order over a tree of counts by value rank: a value
enters and leaves the tree once, and the k-th smallest of what is inside is found by descending it. A task
holds one series at a time, which the calendar bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Ranks:
    """How many values of each rank are inside, summed up in a binary indexed tree."""

    def __init__(self, size: int) -> None:
        self.size, self.sums = size, [0] * (size + 1)
        self.top = 1 << max(0, size.bit_length() - 1)

    def add(self, rank: int, by: int) -> None:
        rank += 1
        while rank <= self.size:
            self.sums[rank] += by
            rank += rank & -rank

    def find(self, k: int) -> int:
        """The rank of the k-th smallest value inside, k from 0."""
        at, step, k = 0, self.top, k + 1
        while step:
            if at + step <= self.size and self.sums[at + step] < k:
                at += step
                k -= self.sums[at]
            step >>= 1
        return at


def trailing_values(day: np.ndarray, value: np.ndarray, known: np.ndarray, days: int, picks: Callable[[int], list[int]]) -> tuple[list, list, list, list]:
    """Per row of a series in day order: count, picked values, first and last day of the known values in [day - days, day)."""
    held, values = day[known].tolist(), value[known]
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rank, ranked = rank.tolist(), values[order].tolist()
    inside = Ranks(len(ranked))
    added = gone = 0
    counts, picked, first, last = [], [], [], []
    for today in day.tolist():
        while added < len(held) and held[added] < today:
            inside.add(rank[added], 1)
            added += 1
        while gone < added and held[gone] < today - days:
            inside.add(rank[gone], -1)
            gone += 1
        n = added - gone
        counts.append(n)
        picked.append([ranked[inside.find(k)] for k in picks(n)] if n else [])
        first.append(held[gone] if n else None)
        last.append(held[added - 1] if n else None)
    return counts, picked, first, last


def trailing_picks(history: DataFrame, by: list[str], value: str, days: int, picks: Callable[[int], list[int]], date: str = "as_of") -> DataFrame:
    """``history`` with ``_n``, ``_picked``, ``_first`` and ``_last`` (days since 1970) of each row's trailing window.

    ``picks(n)`` says which of n sorted values are wanted, by number from 0. Null values do not count; values that are
    not numbers come last. Rows of one day see the same window, none of that day.
    """
    rows = history.withColumns({"_g": F.xxhash64(*by), "_d": F.unix_date(F.col(date)), "_v": F.col(value).cast("double")})
    laid = rows.repartition(*by).sortWithinPartitions(*by, "_d")
    names = laid.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def series() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            one = table.to_batches(max_chunksize=table.num_rows)[0]
            v = one.column("_v")
            found = trailing_values(one.column("_d").to_numpy(), v.to_numpy(zero_copy_only=False).astype(float), v.is_valid().to_numpy(zero_copy_only=False), days, picks)
            kinds = (pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.int32())
            held.clear()
            return pa.RecordBatch.from_arrays([*one.columns, *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], [*names, "_n", "_picked", "_first", "_last"])

        for batch in batches:
            g = batch.column("_g").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and held[0].column("_g")[0].as_py() != int(g[a]):
                    yield series()
                held.append(batch.slice(a, b - a))
        if held:
            yield series()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema)
    return laid.mapInArrow(scan, f"{ddl}, _n int, _picked array<double>, _first int, _last int").drop("_g", "_d", "_v")
