"""Continuous signal intake from landed files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidemark.streaming.clock import BUCKETS, Held, with_clock

#: What a signal is the value of; ``released_at`` and ``value_num`` say which publication of it a row is.
IDENTITY = ["source", "source_id", "segment", "signal_name", "observed_at"]
PUBLISHED, VALUE = "released_at", "value_num"


def read_files(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, files_per_batch: int = 100) -> DataFrame:
    """File-source stream with a fixed schema and bounded batches."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def _order(at: int, value: float | None) -> tuple:
    """Intake order; rows of one moment by value, missing and unordered ones first, so that repeats are neighbours."""
    return at, value is not None and value == value, value is not None, value if value is not None and value == value else 0.0


def _same(a: float | None, b: float | None) -> bool:
    return a == b or (a is not None and b is not None and a != a and b != b)


class LastKept(StatefulProcessor):
    """Per identity: rows the watermark has not passed, the value kept last, and the publications kept.

    Rows with a publication time are told apart by (publication, value) and kept at once, whatever their order.
    Rows without one are a series of values in intake order: one is kept if it differs from the one kept before it,
    so 1, 2, 1 stays three rows. They wait until the watermark has passed them, because an earlier row may still
    land. ``keep_ms`` after its last row an identity is forgotten.

    A group is a bucket of identities. Each is held as [some kept, value kept last, newest, waiting rows, publications].
    """

    def __init__(self, names: list[str], keep_ms: int) -> None:
        self.names, self.keep_ms = names, keep_ms
        self.at, self.value = names.index("_at"), names.index(VALUE)

    def init(self, handle) -> None:
        self.held = Held(handle)

    def _due(self, one: list) -> int:
        return min([one[2] + self.keep_ms, *(r[self.at] for r in one[3])])

    def _keep(self, held: dict) -> None:
        self.held.write(held, min((self._due(one) for one in held.values()), default=None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held, there, changed = self.held.read(), {}, False
        for row in rows:
            at, value, published = row["_at"], row[VALUE], row["_published"]
            # a timer must lie beyond the watermark to fire, so a row right at it is late
            if at <= now:
                yield self._out("late", tuple(row[n] for n in self.names))
                continue
            changed = True
            name = row["_key"]
            one = held.get(name)
            if one is None:
                one = held[name] = [False, None, 0, [], set()]
            one[2] = max(one[2], at)
            if published is None:
                if name not in there:
                    there[name] = {(r[self.at], r[self.value]) for r in one[3]}
                if (at, value) not in there[name]:
                    there[name].add((at, value))
                    one[3].append(tuple(row[n] for n in self.names))
                continue
            # not a number is one value
            which = (published, None if value is None else value if value == value else "nan")
            if which not in one[4]:
                one[4].add(which)
                yield self._out("kept", tuple(row[n] for n in self.names))
        if changed:
            self._keep(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = self.held.read()
        for name, one in list(held.items()):
            for row in sorted((r for r in one[3] if r[self.at] < now), key=lambda r: _order(r[self.at], r[self.value])):
                if not one[0] or not _same(one[1], row[self.value]):
                    one[0], one[1] = True, row[self.value]
                    yield self._out("kept", row)
            one[3] = [r for r in one[3] if r[self.at] >= now]
            if not one[3] and one[2] + self.keep_ms < now:
                del held[name]
        self._keep(held)

    def _out(self, kind: str, row: tuple) -> Row:
        return Row("kind", *self.names[:-2])(kind, *row[:-2])

    def close(self) -> None:
        pass


def drop_repeats(stream: DataFrame, delay: str = "1 hour", keep_days: int = 400, ts: str = "ingested_at", identity: list[str] = IDENTITY) -> DataFrame:  # noqa: B006
    """``kind`` and the columns of ``stream``: rows "kept", and rows "late" for a reject table.

    A repeat is dropped, a revision stays. A row with ``released_at`` repeats one with the same publication and value;
    a row without it repeats the value kept before it. ``delay`` bounds how far files land out of intake order; rows
    behind it are late. State is spread by the whole identity, in buckets, so no source or segment is a hot key. Rows without any part
    of an identity only move the clock.
    """
    names = stream.columns
    published = F.unix_millis(F.col(PUBLISHED).cast("timestamp")) if PUBLISHED in names else F.lit(None).cast("long")
    known = [c for c in identity if c in names]
    real = F.coalesce(*(F.col(c).cast("string") for c in known)).isNotNull() & F.col(ts).isNotNull()
    rows = with_clock(stream.withColumn("_published", published), ts, delay, real)
    rows = rows.withColumn("_key", F.sha2(F.to_json(F.struct(*known), {"ignoreNullFields": "false"}), 256))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    grouped = rows.select(*names, "_at", "_published", "_key", "_bucket", "_clock").groupBy("_bucket")
    keeper = LastKept([*names, "_at", "_published"], keep_days * 86_400_000)
    return grouped.transformWithState(keeper, f"kind string, {out}", "append", "eventtime")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Exactly-once append of everything that has landed, late rows in a folder of their own; returns the started query."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if "kind" in stream.columns:
        writer = writer.partitionBy("kind")
    return writer.trigger(availableNow=True).start()


def appended(spark: SparkSession, path: str, schema: T.StructType, kind: str | None = None) -> DataFrame:
    """What ``append_to`` has written, all of it or one kind."""
    rows = spark.read.schema(schema).parquet(path)
    return rows if kind is None else rows.filter(F.col("kind") == kind).drop("kind")
