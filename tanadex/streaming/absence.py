"""Absences as a stream: state and timers per item."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from tanadex.operators.absence import BACK, GONE

DAY = 24 * 60 * 60 * 1000
EPOCH = dt.date(1970, 1, 1)
EVENT = "source_uid string, last_seen_dt date, dt date, old_value string, new_value string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Absence(StatefulProcessor):
    """State of one item: the last day that is closed and on which it was seen, whether it is gone, and later days.

    A day is closed when the watermark has passed its end; only closed days are judged, in order, so the result does
    not depend on how rows fall into batches. Timers wake an item at the end of a day it was seen on and at the end of
    the day from which it counts as gone. Days leave the state when they are judged.
    """

    def __init__(self, days: int):
        self.days = days

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "day int, gone boolean")
        self.open = handle.getMapState("open", "day int", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        for day in {r["day"] for r in rows}:
            if (day + 1) * DAY > passed and not self.open.containsKey((day,)):
                self.open.updateValue((day,), (True,))
                self.handle.registerTimer((day + 1) * DAY)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        last, gone = self.last.get() if self.last.exists() else (None, False)
        events = []
        for day in sorted(d for (d,) in self.open.keys() if (d + 1) * DAY <= passed):
            if last is not None and day - last > self.days:
                if not gone:
                    events.append((last, last + self.days + 1, BACK, GONE))
                events.append((last, day, GONE, BACK))
            last, gone = day, False
            self.open.removeKey((day,))
        end = None if last is None or gone else (last + self.days + 2) * DAY
        if end is not None and end <= passed:
            events.append((last, last + self.days + 1, BACK, GONE))
            gone = True
        elif end is not None:
            self.handle.registerTimer(end)
        if last is not None:
            self.last.update((last, gone))
        for seen, day, old, new in events:
            yield Row(source_uid=key[0], last_seen_dt=EPOCH + dt.timedelta(seen), dt=EPOCH + dt.timedelta(day),
                      old_value=old, new_value=new)

    def close(self) -> None:
        pass


def use_keyed_state(spark: SparkSession) -> None:
    """State with timers needs the store that keeps it on disk and writes only what a batch has changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def stream_absence(valid: DataFrame, days: int, delay: str = "1 day") -> DataFrame:
    """A stream of (source_uid, last_seen_dt, dt, old_value, new_value): items that were not seen for more than ``days``,
    and that were seen again.

    ``valid`` is a stream of log rows (source_uid, crawl_time). Rows may come up to ``delay`` late; later ones are not
    looked at. When the watermark has closed a day, the events so far are those that ``absence_events`` finds for that
    day as ``as_of``.
    """
    use_keyed_state(valid.sparkSession)
    seen = valid.select("source_uid", "crawl_time", F.unix_date(F.to_date("crawl_time")).alias("day"))
    return (seen.withWatermark("crawl_time", delay).groupBy("source_uid")
            .transformWithState(Absence(days), EVENT, "Append", "EventTime"))
