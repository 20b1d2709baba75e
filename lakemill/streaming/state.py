"""Streams with state of their own: sessions closed by timers, first events whose state expires."""

from __future__ import annotations

import contextlib
import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State of this kind needs a store that can look keys up one by one.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Batches without rows, which move the watermark on. With state that expires by the clock they would never end.
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextlib.contextmanager
def store(spark: SparkSession, idle: bool = True) -> Iterator[None]:
    """Streams that are started inside keep their state in :data:`STORE`; the session's own choice comes back afterwards.

    ``idle`` says whether batches without rows are run, which timers on the watermark need at the end of what is there.
    """
    before = {name: spark.conf.get(name, None) for name in (STORE[0], IDLE)}
    spark.conf.set(*STORE)
    spark.conf.set(IDLE, str(idle).lower())
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class Sessions(StatefulProcessor):
    """Sessions of a key, each given out once when the watermark has passed its end.

    A list holds the times of the events of open sessions, as they came. A timer
    stands at the end of the first of them, and a value says where; when it goes off, all
    that the watermark has passed is closed, and the timer moves on.
    """

    def __init__(self, key: str, gap: datetime.timedelta):
        self.key, self.gap = key, int(gap / datetime.timedelta(microseconds=1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")
        self.times = handle.getListState("times", "at long")

    def _over(self, session: list[int]) -> int:
        """The first millisecond at which the watermark says that nothing more will come."""
        return -(-(session[-1] + self.gap) // 1000)

    def _close(self, key, times: list[int], watermark: int) -> pd.DataFrame:
        sessions: list[list[int]] = []
        for t in sorted(times):
            if sessions and t - sessions[-1][-1] <= self.gap:
                sessions[-1].append(t)
            else:
                sessions.append([t])
        closed = [s for s in sessions if self._over(s) <= watermark]
        still = sessions[len(closed) :]
        at = self.timer.get()[0] if self.timer.exists() else None
        due = self._over(still[0]) if still else None
        if at != due and at is not None:
            self.handle.deleteTimer(at)
        if still:
            self.times.put([(t,) for s in still for t in s])
            if at != due:
                self.handle.registerTimer(due)
                self.timer.update((due,))
        else:
            self.times.clear()
            self.timer.clear()
        return pd.DataFrame({self.key: [key] * len(closed), "began": [s[0] for s in closed], "ended": [s[-1] for s in closed], "n": [len(s) for s in closed]})

    def _held(self) -> list[int]:
        return [t for (t,) in self.times.get()] if self.times.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield self._close(key[0], self._held() + [t for batch in rows for t in batch["micros"].tolist()], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._close(key[0], self._held(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def timed_sessions(events: DataFrame, key: str, time: str, gap: datetime.timedelta, late: str) -> DataFrame:
    """(``key``, began, ended, n): sessions of events at most ``gap`` apart, closed by timers on the watermark, ``late`` behind.

    Events of a session that came out of order are put in order; those behind the watermark are dropped.
    A key's open events are in its state. Has to be started within :func:`store`.
    """
    rows = events.where(f"`{key}` is not null and `{time}` is not null").withWatermark(time, late).select(key, time, F.unix_micros(time).alias("micros"))
    kind = events.schema[key].dataType.simpleString()
    found = rows.groupBy(key).transformWithStateInPandas(Sessions(key, gap), f"`{key}` {kind}, began long, ended long, n long", "append", "eventTime")
    return found.select(key, F.timestamp_micros("began").alias("began"), F.timestamp_micros("ended").alias("ended"), "n")


class FirstSeen(StatefulProcessor):
    """The first row of each key since its state expired: a value that says so lives for ``ttl`` of processing time.

    Keys are many and have few rows, so that rows come and go as rows, in batches of many keys, not as a frame for each key.
    """

    def __init__(self, order: str, ttl: datetime.timedelta):
        self.order, self.ttl = order, int(ttl / datetime.timedelta(milliseconds=1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        self.seen.update((True,))
        yield min(rows, key=self._place)

    def _place(self, row: Row) -> tuple:
        """Nulls come last. Rows hold times by the local clock, on which an hour may come twice."""
        at = row[self.order]
        return at is None, at.timestamp() if isinstance(at, datetime.datetime) else at or 0

    def close(self) -> None:
        pass


def first_seen(events: DataFrame, keys: list[str], order: str, ttl: datetime.timedelta) -> DataFrame:
    """The first row of each key by ``order`` in the first batch that has the key, and again once the key's state is older than ``ttl``.

    State goes by itself, so that it stays as large as the keys of ``ttl`` are many. Has to be started within :func:`store`.
    """
    return events.groupBy(*keys).transformWithState(FirstSeen(order, ttl), events.schema, "append", "processingTime")
