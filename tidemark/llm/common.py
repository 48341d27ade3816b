"""Shared helpers: stored steps, document keys, and words of Arrow batches as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

#: Texts are worked on in slices of about this many bytes.
SLICE_BYTES = 1 << 20
LAST_ID = (1 << 63) - 1
#: ASCII white space; everything else belongs to a word.
SPACES = b" \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Constants of the integer mixer (splitmix64).
MIX_1, MIX_2, MIX_3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
BASE = 0xD6E8FEB86659FD93


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder once and read it back: no recomputation, no lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` and the row's key: ``id`` (a null doc_id sorts last) and ``th``, a hash of the text.

    Rows that repeat both are the same document to every operator and get the same result.
    """
    return docs.select("doc_id", *more, "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("th"))


def lanes(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit integers; a one-to-one map."""
    x = x + np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_2)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_3)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    flat = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each are about ``limit`` bytes; a longer text comes alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offs = raw(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    ups, downs = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    ups[:1] = downs[:1] = 1
    return np.multiply.accumulate(ups), np.multiply.accumulate(downs)


class Hasher:
    """Hashes of spans of a sequence, by prefix sums over blocks of bounded size.

    ``spans`` hashes words of any length: every byte is scrambled together with its place in the word, and the
    scrambled values are added, so no rule between places lets different words meet. ``grams`` hashes short runs
    by powers of a base; for runs far shorter than a thousand values that has no such families either.
    """

    BLOCK = 1 << 20
    #: Places whose scrambled bytes are looked up.
    PLACES = 64

    def __init__(self) -> None:
        self.ups, self.downs = powers(self.BLOCK + 1)
        self.scrambled = mix(np.arange(self.PLACES << 8, dtype=np.uint64) + np.uint64(BASE))

    def _grow(self, n: int) -> None:
        if n > len(self.ups):
            self.ups, self.downs = powers(n)

    def _placed(self, part: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scrambled (place, byte) of every byte from the first start on; the place counts from the last start."""
        at = np.arange(starts[0], len(part)) - np.repeat(starts, np.diff(np.append(starts, len(part))))
        at = (at << 8) | part[starts[0] :]
        out = self.scrambled[np.minimum(at, len(self.scrambled) - 1)]
        far = np.flatnonzero(at >= len(self.scrambled))
        if len(far):
            out[far] = mix(at[far].astype(np.uint64) + np.uint64(BASE))
        return out

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes ``values[s:e]`` for ascending, disjoint spans."""
        out = np.zeros(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            first = int(starts[at])
            end = max(at + 1, int(np.searchsorted(ends, first + self.BLOCK, side="right")))
            part = values[first : int(ends[end - 1])]
            sums = np.zeros(len(part) + 1, np.uint64)
            s, e = starts[at:end] - first, ends[at:end] - first
            np.cumsum(self._placed(part, s), out=sums[1:])
            out[at:end] = sums[e] - sums[s]
            at = end
        return mix(out)

    def grams(self, values: np.ndarray, k: int) -> np.ndarray:
        """Hash of every run of ``k`` values."""
        n = len(values) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.empty(n, np.uint64)
        for at in range(0, n, self.BLOCK):
            part = values[at : at + self.BLOCK + k - 1].astype(np.uint64)
            self._grow(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part + np.uint64(1)) * self.ups[: len(part)], out=sums[1:])
            m = len(part) - k + 1
            out[at : at + m] = (sums[k : k + m] - sums[:m]) * self.downs[:m]
        return mix(out)


def word_table(separators: bytes = SPACES) -> np.ndarray:
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return inside


def words(flat: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each row (one entry more than rows)."""
    n = len(flat)
    w = inside[flat]
    before = np.zeros(n, bool)
    before[1:] = w[:-1]
    edges = offs[:-1][offs[:-1] < n]
    before[edges] = False
    after = np.zeros(n, bool)
    after[:-1] = w[1:]
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hex64(column: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
