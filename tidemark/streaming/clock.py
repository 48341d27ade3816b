"""Streams whose late rows are kept apart instead of vanishing.

Spark drops rows behind the watermark before a stateful operator sees them. Here every landed row gives two:
one that only moves the watermark, and the row itself without an event time, which nothing drops. The
operators compare its time with the watermark themselves: a row of a moment that is already settled comes out
with ``kind`` "late", everything else is judged when the watermark has passed its moment, so results do not
depend on the order or the batches in which files land.

A stream can only settle what the watermark has passed. A row without a key and with a later time (a heartbeat)
moves it on when nothing else lands.
"""

from __future__ import annotations

import pickle

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOCK = "_clock"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def with_clock(stream: DataFrame, ts: str, delay: str, real: Column) -> DataFrame:
    """``stream`` with ``_at`` (milliseconds of ``ts``) and a watermark that its own rows move but never fall behind.

    Rows that are not ``real`` only move it.
    """
    # keyed state of transformWithState lives in RocksDB on local disk and in the checkpoint, not in memory
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    stamped = stream.withColumn("_at", F.unix_millis(F.col(ts).cast("timestamp")))
    moment = F.col(ts).cast("timestamp")
    twice = F.when(real, F.array(moment, F.lit(None).cast("timestamp"))).otherwise(F.array(moment))
    return stamped.withColumn(CLOCK, F.explode(twice)).withWatermark(CLOCK, delay).filter(F.col(CLOCK).isNull())


#: Keys are dealt over so many buckets. A bucket is one key of a stateful operator and holds its keys in one value.
BUCKETS = 1024


class Held:
    """The keys of one bucket: a dictionary in one state value, and one timer at the earliest moment any of them is due.

    Every call from Python to the state store costs as much as some hundred rows, so a bucket is read and written
    once per batch, however many of its keys the batch touches.
    """

    def __init__(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "b binary")

    def read(self) -> dict:
        return pickle.loads(self.state.get()[0]) if self.state.exists() else {}

    def write(self, held: dict, due: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.state.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))
            self.handle.registerTimer(due)
        else:
            self.state.clear()
