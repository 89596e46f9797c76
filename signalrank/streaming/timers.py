"""State that ends by itself: a cache whose entries expire, and alerts that fire as their day comes.

Both keep a few values for each key and a timer of event time, and need Spark's RocksDB state store (`uses_timers`).
The batch operators `incremental.answered` and `incremental.due_alerts` say the same over landed tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from signalrank.functions.dates import THRESHOLDS

MS_AN_HOUR = 3_600_000


def uses_timers(spark: SparkSession) -> SparkSession:
    """Sets the state store that timers need, for streams that this session starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class _Cache(StatefulProcessor):
    """The last answer of a key, until `hours` after it was stored."""

    def __init__(self, hours: int):
        self.life = hours * MS_AN_HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, stored_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        frame = frame.assign(at=[_ms(t) for t in frame["ts"]], asked=frame["value"].isna()).sort_values(["at", "asked"], kind="stable")
        value, stored_at = self.entry.get() if self.entry.exists() else (None, None)
        before, out = stored_at, []
        for ts, at, asked, new in zip(frame["ts"], frame["at"], frame["asked"], frame["value"]):
            if not asked:
                if stored_at is None or at >= stored_at:
                    value, stored_at = new, at
            else:
                out.append((key[0], ts, value if stored_at is not None and stored_at <= at < stored_at + self.life else None))
        if stored_at is not None and stored_at != before:
            if before is not None:
                self.handle.deleteTimer(before + self.life)
            self.entry.update((value, stored_at))
            self.handle.registerTimer(stored_at + self.life)
        yield pd.DataFrame(out, columns=["key", "ts", "answer"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and self.entry.get()[1] + self.life <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        yield pd.DataFrame(columns=["key", "ts", "answer"])

    def close(self) -> None:
        pass


def cached_answers(log: DataFrame, hours: int = 12, late: str = "0 seconds") -> DataFrame:
    """(key, ts, answer) for each question of a stream (key, ts, value): rows with a value are answers to keep, rows without ask for one. A null answer is to be fetched."""
    keyed = log.select("key", "ts", "value").withWatermark("ts", late).groupBy("key")
    return keyed.transformWithStateInPandas(_Cache(hours), "key string, ts timestamp, answer string", "append", "eventTime")


class _Alerts(StatefulProcessor):
    """A deadline's day, the thresholds that it was told of, and the last day it was looked at; one timer, for the next threshold."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deadline = handle.getValueState("deadline", "due date, notified array<int>, seen date")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, notified, seen = self.deadline.get() if self.deadline.exists() else (None, [], None)
        notified, out = set(notified or []), []
        for row in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples():
            while (day := _next(due, seen)) is not None and day < row.ts.date():  # what the old day told before this row came
                seen = day
                out += _told(key[0], due, seen, notified)
            due = None if pd.isna(row.deadline_date) else row.deadline_date
            notified |= set(() if row.notified_days is None else map(int, row.notified_days))
            seen = max(x for x in (seen, row.ts.date()) if x is not None)
            out += _told(key[0], due, seen, notified)
        yield self._wait(key[0], due, notified, seen, out, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if self.deadline.exists():
            due, notified, seen = self.deadline.get()
            yield self._wait(key[0], due, set(notified or []), seen, out, timerValues)

    def _wait(self, name: str, due: date | None, notified: set[int], seen: date, out: list[tuple], timerValues) -> pd.DataFrame:
        """Tells of the thresholds whose day the watermark has passed, and sets the timer for the next one; without a next one nothing is kept."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        now = timerValues.getCurrentWatermarkInMs()
        while (day := _next(due, seen)) is not None and _midnight(day) <= now:
            seen = day
            out += _told(name, due, seen, notified)
        if day is None:
            self.deadline.clear()
        else:
            self.deadline.update((due, sorted(notified), seen))
            self.handle.registerTimer(_midnight(day))
        return pd.DataFrame(out, columns=["deadline_id", "threshold", "days", "day"])

    def close(self) -> None:
        pass


def _told(name: str, due: date | None, day: date, notified: set[int]) -> list[tuple]:
    """The alert of that day, if there is a new one; its threshold is then among the notified."""
    days = -1 if due is None else (due - day).days
    threshold = min((t for t in THRESHOLDS if t >= days), default=None) if days >= 0 else None
    if threshold is None or threshold in notified:
        return []
    notified.add(threshold)
    return [(name, threshold, days, day)]


def _next(due: date | None, seen: date | None) -> date | None:
    """The next day after `seen` on which a threshold is reached."""
    return None if due is None or seen is None else min((d for d in (due - timedelta(days=t) for t in THRESHOLDS) if d > seen), default=None)


def _ms(ts) -> int:
    ts = pd.Timestamp(ts)
    return (ts.tz_localize("UTC") if ts.tzinfo is None else ts).value // 1_000_000


def _midnight(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp()) * 1000


def alerts(deadlines: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(deadline_id, threshold, days, day): each threshold of a deadline once, on the day that it is reached.

    deadlines is a stream (deadline_id, deadline_date, notified_days, ts); a later row of a deadline replaces its day and
    adds to what it was told of. Days pass as the stream's event time does. Times are UTC, as the session's should be.
    """
    keyed = deadlines.select("deadline_id", "deadline_date", "notified_days", "ts").withWatermark("ts", late).groupBy("deadline_id")
    return keyed.transformWithStateInPandas(_Alerts(), "deadline_id string, threshold int, days int, day date", "append", "eventTime")
