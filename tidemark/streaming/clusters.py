"""Streaming cluster alerts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.constants import CLUSTER_DAYS, CLUSTER_THRESHOLD
from tidemark.streaming.clock import BUCKETS, DAY_MS, Held, with_clock

CHANGES = "ticker string, insider string, at long, day int, delta int, filed boolean"
ALERTS = "kind string, ticker string, day date, n bigint, insider string, at timestamp"
CHANGE, ALERT = (Row(*(part.split()[0] for part in ddl.split(", "))) for ddl in (CHANGES, ALERTS))


def settled_day(watermark_ms: int) -> int:
    """The last day (since 1970) whose end the watermark is beyond, as a timer at its end sees it."""
    return (watermark_ms - 1) // DAY_MS - 1


def settle(pending: list[int], last: int | None, upto: int, days: int) -> tuple[list[tuple[int, int, bool]], list[int], int | None]:
    """Changes (day, delta, filed) of one insider's cover up to a settled day; what stays pending; the cover's last purchase.

    A purchase covers ``days`` days. A cover starts with +1 and ends with -1 unless a purchase extends it.
    """
    out = []
    for day in sorted(d for d in pending if d <= upto):
        if last is not None and last + days < day:
            out.append((last + days, -1, False))
            last = None
        out.append((day, int(last is None), True))
        last = day
    rest = sorted(d for d in pending if d > upto)
    if last is not None and last + days <= upto:
        out.append((last + days, -1, False))
        last = None
    return out, rest, last


class Covers(StatefulProcessor):
    """Per (ticker, insider): purchase days that are not settled yet, and the last settled one while its cover lasts.

    Nothing is judged when a row arrives. An event-time timer at the end of the earliest pending day, or of
    the cover, settles whatever the watermark has passed, in day order. With no cover and nothing pending the
    state is gone. A group is a bucket of such pairs; changes of a ticker on a day are added up before they leave it.
    """

    def __init__(self, days: int) -> None:
        self.days = days

    def init(self, handle) -> None:
        self.held = Held(handle)

    def _due(self, pending: list[int], last: int | None) -> int:
        return (min([*pending[:1], *([] if last is None else [last + self.days])]) + 1) * DAY_MS

    def _keep(self, held: dict) -> None:
        self.held.write(held, min((self._due(*one) for one in held.values()), default=None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # a timer must lie beyond the watermark to fire, so a day that ends right at it takes no more rows
        upto = timerValues.getCurrentWatermarkInMs() // DAY_MS - 1
        held, days = self.held.read(), {}
        for row in rows:
            pair, day = (row["ticker"], row["insider"]), row["_at"] // DAY_MS
            if day <= upto:
                yield CHANGE(*pair, row["_at"], None, None, None)
            else:
                if pair not in days:
                    days[pair] = set(held[pair][0]) if pair in held else set()
                days[pair].add(day)
        for pair, found in days.items():
            held[pair] = (sorted(found), held[pair][1] if pair in held else None)
        if days:
            self._keep(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto, held, changes = settled_day(timerValues.getCurrentWatermarkInMs()), self.held.read(), {}
        for pair, one in list(held.items()):
            out, pending, last = settle(*one, upto, self.days)
            for day, delta, filed in out:
                had = changes.setdefault((pair[0], day), [0, False])
                had[0], had[1] = had[0] + delta, had[1] or filed
            if pending or last is not None:
                held[pair] = (pending, last)
            else:
                del held[pair]
        self._keep(held)
        for (ticker, day), (delta, filed) in changes.items():
            if delta or filed:
                yield CHANGE(ticker, None, None, day, delta, filed)

    def close(self) -> None:
        pass


def alerts_of(changes: list[tuple[int, int, bool]], n: int, k: int) -> tuple[list[tuple[int, int]], int]:
    """(day, insiders) of the filing days on which the count first reaches ``k``, and the count behind them."""
    days: dict[int, list] = {}
    for day, delta, filed in changes:
        had = days.setdefault(day, [0, False])
        had[0], had[1] = had[0] + delta, had[1] or filed
    out = []
    for day in sorted(days):
        delta, filed = days[day]
        if filed and n + delta >= k > n:
            out.append((day, n + delta))
        n += delta
    return out, n


class Alerts(StatefulProcessor):
    """Per ticker: how many insiders are covered. Changes come settled and in batches of ascending days."""

    def __init__(self, k: int) -> None:
        self.k = k

    def init(self, handle) -> None:
        self.count = handle.getValueState("count", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        changes = []
        for row in rows:
            if row["day"] is None:
                yield ALERT("late", key[0], None, None, row["insider"], dt.datetime.fromtimestamp(row["at"] / 1000))
            else:
                changes.append((row["day"], row["delta"], row["filed"]))
        if not changes:
            return
        had = self.count.get()[0] if self.count.exists() else 0
        found, n = alerts_of(changes, had, self.k)
        if n:
            self.count.update((n,))
        elif had:
            self.count.clear()
        for day, seen in found:
            yield ALERT("alert", key[0], dt.date(1970, 1, 1) + dt.timedelta(days=day), seen, None, None)

    def close(self) -> None:
        pass


def stream_clusters(
    stream: DataFrame, days: int = CLUSTER_DAYS, k: int = CLUSTER_THRESHOLD, late_days: int = 3, ts: str = "ts"
) -> DataFrame:
    """R2: (kind, ticker, day, n, insider, at): alerts on the days whose distinct insiders first reach ``k``, and late rows.

    A day is judged once, when the watermark (``late_days`` behind the latest row) has passed its end, so the alerts
    are those of ``operators.clusters.cluster_events`` over all rows that were not late, whatever the files' order.
    The first state is spread by buckets of (ticker, insider), a ticker over 32 of them, and turns purchases into cover
    changes per day; the second holds one number per ticker, and a batch gives it at most 32 changes per newly settled
    day, so a ticker with a third of all rows has neither a large state nor all its rows in one task. Rows without ticker or insider only move the clock.
    """
    real = F.col("ticker").isNotNull() & F.col("insider").isNotNull() & F.col(ts).isNotNull()
    taken = with_clock(stream.select("ticker", F.col("insider").cast("string").alias("insider"), ts), ts, f"{late_days} days", real)
    side = int(BUCKETS**0.5)
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    dealt = taken.select("ticker", "insider", "_at", "_clock", (part("ticker") * side + part("insider")).cast("int").alias("_bucket"))
    changes = dealt.groupBy("_bucket").transformWithState(Covers(days), CHANGES, "append", "eventtime")
    return changes.groupBy("ticker").transformWithState(Alerts(k), ALERTS, "append", "none")
