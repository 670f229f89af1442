"""Change capture against a plain row-by-row fold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tanadex.operators import changes

SCHEMA = ("log_id long, category string, site string, item_id string, brand_name string, model_name string, "
          "model_no string, currency string, price int, image_original_key string, image_thumb_300_key string, "
          "image_thumb_600_key string, image_sha256 string, product_url string, status string, "
          "crawl_time timestamp, dt date")
TINY = changes.Skew(chunk_rows=3)


def row(log_id, item, price, status="success", site="s", category="watch"):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=(log_id * 7) % 100)
    return (log_id, category, site, item, f"b{log_id}", "m", "n", "JPY", price, None, None, None, None,
            f"u{log_id}", status, at, at.date())


def fold(rows, null_price="absorb"):
    """Rows in log order, one at a time: (changes, items)."""
    found, items = [], {}
    for r in sorted(rows):
        if r[14] != "success" or not all(x.strip() for x in (r[2], r[1], r[3])):
            continue
        uid, price = f"{r[2]}:{r[1]}:{r[3]}", r[8]
        if uid not in items:
            items[uid] = {"price": price, "version": 1, "brand": r[4], "last": r[0], "first_dt": r[16]}
            continue
        item = items[uid]
        item["last"] = r[0]
        if null_price == "skip":
            if price is None:
                continue
            if item["price"] is None:
                item["price"] = price
                continue
        if item["price"] is not None and price != item["price"]:
            found.append((uid, r[0], item["price"], price, item["version"] + 1))
            item["price"], item["version"] = price, item["version"] + 1
    return sorted(found, key=str), items


def collected(frame):
    return sorted((tuple(r) for r in frame.select(
        "source_uid", "log_id", "old_price", "new_price", "version").collect()), key=str)


def random_rows(seed, n=160):
    rnd = random.Random(seed)
    # One item holds about a third of the rows.
    return [row(k, "hot" if rnd.random() < 0.35 else f"i{rnd.randrange(12)}",
                None if rnd.random() < 0.02 else rnd.choice([100, 120, 90]),
                "failed" if rnd.random() < 0.1 else "success") for k in range(1, n + 1)]


@pytest.mark.parametrize("prices,expected,final", [
    ([100], [], (100, 1)),
    ([100, 100, 120, 120, 90], [(100, 120), (120, 90)], (90, 3)),
    ([None, 100, 120], [], (None, 1)),
    ([100, None, 120], [(100, None)], (None, 2)),
])
def test_stated_cases(spark, prices, expected, final):
    rows = [row(k + 1, "x", p) for k, p in enumerate(prices)]
    valid = changes.valid_log(spark.createDataFrame(rows, SCHEMA))
    assert [(r[2], r[3]) for r in sorted(collected(changes.price_changes(valid)), key=lambda r: r[1])] == expected
    item = changes.current_items(valid).first()
    assert (item.price, item.version) == final


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("null_price", ["absorb", "skip"])
@pytest.mark.parametrize("skew", [changes.Skew(), TINY])
def test_same_as_fold(spark, seed, null_price, skew):
    rows = random_rows(seed)
    log = spark.createDataFrame(rows, SCHEMA)
    valid = changes.valid_log(changes.pending_log(log))
    expected, items = fold(rows, null_price)
    assert collected(changes.price_changes(valid, null_price=null_price, skew=skew)) == expected
    got = {r.source_uid: (r.price, r.version, r.brand_name, r.last_log_id, r.first_seen_dt)
           for r in changes.current_items(valid, null_price=null_price, skew=skew).collect()}
    assert got == {u: (i["price"], i["version"], i["brand"], i["last"], i["first_dt"]) for u, i in items.items()}


@pytest.mark.parametrize("skew", [changes.Skew(), TINY])
def test_batches_equal_one_run(spark, skew):
    rows = random_rows(9)
    log = spark.createDataFrame(rows, SCHEMA)
    whole = changes.valid_log(changes.pending_log(log))
    snapshot, found = None, []
    for low, high in ((0, 30), (30, 31), (31, 120), (120, 1000)):
        part = changes.valid_log(changes.pending_log(log.where((F.col("log_id") > low) & (F.col("log_id") <= high))))
        found += collected(changes.price_changes(part, snapshot, skew=skew))
        rows_now = changes.current_items(part, snapshot, skew=skew).collect()
        snapshot = spark.createDataFrame(rows_now, changes.current_items(part, snapshot).schema)
    assert sorted(found, key=str) == fold(rows)[0]
    columns = sorted(snapshot.columns)
    once = changes.current_items(whole)
    assert sorted(map(str, snapshot.select(*columns).collect())) == sorted(map(str, once.select(*columns).collect()))


def test_rejects_and_cursor(spark):
    log = spark.createDataFrame([row(1, "a", 1), row(2, " ", 2), row(3, "c", 3, category=""),
                                 row(4, "d", 4, "failed")], SCHEMA)
    pending = changes.pending_log(log)
    assert sorted(r.log_id for r in changes.rejected_log(pending).collect()) == [2, 3]
    assert changes.next_cursor(pending).first()[0] == 3
    assert changes.next_cursor(changes.pending_log(log, 3), 3).first()[0] == 3
    assert [r.log_id for r in changes.pending_log(log, 0, 2).collect()] == [1, 2]


def test_infinite_price_is_rejected(spark):
    log = spark.createDataFrame([row(1, "a", 1), row(2, "b", 2)], SCHEMA).withColumn(
        "price", F.when(F.col("log_id") == 1, F.lit(float("inf"))).otherwise(F.lit(12.9)))
    assert [r.log_id for r in changes.rejected_log(log).collect()] == [1]
    assert [r.price for r in changes.valid_log(log).collect()] == [12]


def test_replayed_history_is_the_same(spark):
    valid = changes.valid_log(spark.createDataFrame(random_rows(3), SCHEMA))
    first = changes.new_history(changes.price_history(changes.price_changes(valid)), None)
    again = changes.new_history(changes.price_history(changes.price_changes(valid)), first)
    assert first.count() > 0 and again.count() == 0


def test_not_seen(spark):
    valid = changes.valid_log(spark.createDataFrame([row(1, "a", 1), row(2, "b", 2)], SCHEMA))
    items = changes.current_items(valid)
    sold = changes.not_seen(items, "2024-03-01", 30)
    events = changes.status_history(sold, F.lit("2024-03-01 00:00:00").cast("timestamp")).collect()
    assert {(e.old_value, e.new_value, e.reason) for e in events} == {("active", "sold", "not_seen_for_30_days")}
    assert changes.not_seen(items, "2024-01-05", 30).count() == 0
