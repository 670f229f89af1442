"""Absences against a walk over days, and the stream against the batch."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tanadex.operators import absence
from tanadex.streaming.absence import stream_absence

START = dt.date(2024, 1, 1)


def seen_days(seed=1, items=30, days=40):
    rng = random.Random(seed)
    return {f"s:{k}": sorted({START + dt.timedelta(rng.choice([0, 3, 3, 4, 9, rng.randrange(days)])) for _ in range(rng.randint(1, 9))})
            for k in range(items)}


def walk(seen, n, as_of):
    """Day by day: gone when more than n days have passed since the last one, back when seen."""
    out = []
    for uid, days in seen.items():
        days = [d for d in days if d <= as_of]
        for last, back in zip(days, [*days[1:], None]):
            gone = last + dt.timedelta(n + 1)
            if gone <= (back or as_of):
                out.append((uid, last, gone, "active", "sold"))
                if back:
                    out.append((uid, last, back, "sold", "active"))
    return sorted(out)


def table(spark, seen, twice=True):
    rows = [(uid, d) for uid, ds in seen.items() for d in ds for _ in range(1 + twice)]
    return spark.createDataFrame(rows, "source_uid string, dt date")


@pytest.mark.parametrize("as_of", [START + dt.timedelta(12), START + dt.timedelta(39)])
def test_absences_against_a_walk(spark, as_of):
    seen = seen_days()
    found = absence.absences(absence.observation_days(table(spark, seen)), [0, 1, 3, 7], F.lit(as_of))
    events = absence.absence_events(found).collect()
    for n in (0, 1, 3, 7):
        got = sorted((r.source_uid, r.last_seen_dt, r.dt, r.old_value, r.new_value) for r in events if r.days == n)
        assert got == walk(seen, n, as_of) and got
    history = absence.absence_history(absence.absence_events(found.where("days = 3")), F.lit("2024-03-01").cast("timestamp"))
    assert history.count() == history.select("event_key").distinct().count() == len(walk(seen, 3, as_of))
    assert absence.absences(absence.observation_days(table(spark, {"a": []}, False)), [1]).count() == 0


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def test_stream_equals_batch_over_batches_and_a_restart(spark, tmp_path):
    """Rows come in order of days, some a day late; the query is stopped and started again after every batch."""
    seen, n = seen_days(7, 40), 3
    rng = random.Random(3)
    rows = [(uid, dt.datetime.combine(d, dt.time(rng.randrange(24)))) for uid, ds in seen.items() for d in ds]
    rows.sort(key=lambda r: (r[1] + dt.timedelta(hours=rng.randrange(20)), r[0]))
    edge = START + dt.timedelta(60)
    batches = [rows[k::1][:len(rows) // 5 + 1] for k in range(0, len(rows), len(rows) // 5 + 1)]
    batches += [[("s:last", dt.datetime.combine(edge, dt.time(0)))], [("s:last", dt.datetime.combine(edge, dt.time(1)))]]
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    os.makedirs(source)
    for batch in batches:
        spark.createDataFrame(batch, "source_uid string, crawl_time timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("source_uid string, crawl_time timestamp").parquet(source)
        query = (stream_absence(stream, n).writeStream.format("parquet").option("checkpointLocation", checkpoint)
                 .outputMode("append").trigger(availableNow=True).start(sink))
        query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema("source_uid string, last_seen_dt date, dt date, old_value string, new_value string")
                 .parquet(sink).collect())
    # The watermark stands a day before the last row: the day before that is the last one closed.
    as_of = edge - dt.timedelta(2)
    assert got == walk({k: v for k, v in seen.items()}, n, as_of) and len(got) > 40
