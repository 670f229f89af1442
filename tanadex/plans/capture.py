"""Queries over the crawl log: scans, change capture, history, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tanadex.operators import absence, changes, listing
from tanadex.operators.scale import saved
from tanadex.plans.registry import query

# ---- SQL of the checks -------------------------------------------------------------

# The row-by-row meaning of change capture, stated with plain windows.
FOLD = """
ok AS (SELECT *, trim(site) || ':' || trim(category) || ':' || trim(item_id) AS uid FROM crawl_log
       WHERE status = 'success' AND trim(category) <> ''),
steps AS (SELECT *, row_number() OVER w AS rn, lag(price) OVER w AS before,
            coalesce(max(CASE WHEN price IS NULL THEN 1 ELSE 0 END)
              OVER (PARTITION BY uid ORDER BY log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stuck
          FROM ok WINDOW w AS (PARTITION BY uid ORDER BY log_id)),
marked AS (SELECT *, rn > 1 AND stuck = 0 AND price IS DISTINCT FROM before AS changed FROM steps),
seen AS (SELECT *, 1 + sum(CASE WHEN changed THEN 1 ELSE 0 END)
                        OVER (PARTITION BY uid ORDER BY log_id) AS version FROM marked)
"""

CURRENT = """
firsts AS (SELECT uid, min(log_id) AS first_id, max(log_id) AS last_id, max(version) AS version,
             max(CASE WHEN changed THEN log_id END) AS change_id,
             max(CASE WHEN price IS NULL THEN 1 ELSE 0 END) AS has_null FROM seen GROUP BY uid),
item AS (SELECT row_number() OVER (ORDER BY first_id) AS id, f.uid AS source_uid, a.brand_name, a.model_no,
           a.currency, CASE WHEN has_null = 1 THEN NULL ELSE CAST(z.price AS BIGINT) END AS price,
           z.product_url, 'active' AS status, a.dt AS first_seen_dt, z.dt AS last_seen_dt,
           z.crawl_time AS last_crawl_time, f.last_id AS last_log_id,
           c.crawl_time AS price_last_changed_at, c.dt AS price_last_changed_dt,
           CAST(f.version AS INT) AS version
         FROM firsts f JOIN ok a ON a.log_id = f.first_id JOIN ok z ON z.log_id = f.last_id
         LEFT JOIN ok c ON c.log_id = f.change_id)
"""
CURRENT_COLUMNS = ("id", "source_uid", "brand_name", "model_no", "currency", "price", "product_url", "status",
                   "first_seen_dt", "last_seen_dt", "last_crawl_time", "last_log_id",
                   "price_last_changed_at", "price_last_changed_dt", "version")

HISTORY = """
hist AS (SELECT dt, uid AS source_uid, crawl_time AS change_time, 'price' AS change_type,
           CAST(before AS VARCHAR) AS old_value, CAST(price AS VARCHAR) AS new_value, currency,
           'crawler_update' AS reason, log_id, CAST(version AS BIGINT) AS item_version,
           sha256(concat_ws(':', uid, 'price', CAST(log_id AS VARCHAR), CAST(price AS VARCHAR))) AS event_key
         FROM seen WHERE changed)
"""

GONE_DAYS = 0
SOLD = f"""
gone AS (SELECT i.*, m.as_of FROM item i JOIN (SELECT max(dt) AS as_of FROM crawl_log) m
           ON i.last_seen_dt < m.as_of - {GONE_DAYS})
"""


def with_(*parts: str) -> str:
    """More common table expressions after the input ones."""
    return ", " + ", ".join(p.strip() for p in parts) + " "


def _valid(i):
    return changes.valid_log(changes.pending_log(i.crawl_log, -1))


def _changes(i):
    return changes.price_changes(_valid(i))


def _current(i):
    return changes.current_items(_valid(i))


# ---- scans ----------------------------------------------------------------------------

@query("log_scan_incremental", """
SELECT log_id, category, site, item_id, raw_json, brand_name, model_name, model_no, currency, price,
  image_original_key, image_thumb_300_key, image_thumb_600_key, image_sha256, product_url, crawl_time, dt
FROM crawl_log WHERE log_id > 0 AND status = 'success'""", "crawl_log")
def log_scan_incremental(i):
    return changes.pending_log(i.crawl_log, 0).drop("status")


@query("log_pending_count",
       "SELECT count(*) AS n_pending FROM crawl_log WHERE log_id > 0 AND status = 'success'", "crawl_log")
def log_pending_count(i):
    return changes.pending_count(i.crawl_log, 0)


@query("recent_log", """
SELECT log_id, site, item_id, price, crawl_time FROM crawl_log ORDER BY crawl_time DESC, log_id DESC LIMIT 5""",
       "crawl_log")
def recent_log(i):
    return listing.recent_log(i.crawl_log).select("log_id", "site", "item_id", "price", "crawl_time")


# ---- items ----------------------------------------------------------------------------

@query("price_changes", with_(FOLD) + """
SELECT uid AS source_uid, log_id, CAST(before AS BIGINT) AS old_price, CAST(price AS BIGINT) AS new_price,
  CAST(version AS BIGINT) AS version FROM seen WHERE changed""", "crawl_log")
def price_changes(i):
    return _changes(i).select("source_uid", "log_id", "old_price", "new_price", "version")


@query("item_first_seen", with_(FOLD) + """
SELECT uid AS source_uid, log_id AS first_log_id, trim(site) AS site, trim(category) AS category,
  trim(item_id) AS item_id, brand_name, model_name, model_no, currency, image_sha256, image_original_key,
  image_thumb_300_key, image_thumb_600_key, CAST(price AS BIGINT) AS first_price, dt AS first_seen_dt
FROM seen WHERE rn = 1""", "crawl_log")
def item_first_seen(i):
    return changes.first_seen(_valid(i))


@query("item_last_seen", with_(FOLD) + """
SELECT uid AS source_uid, dt AS last_seen_dt, crawl_time AS last_crawl_time, log_id AS last_log_id, product_url
FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY log_id DESC) AS back FROM ok) WHERE back = 1""",
       "crawl_log")
def item_last_seen(i):
    return changes.last_seen(_valid(i))


@query("item_current", with_(FOLD, CURRENT) + f"SELECT {', '.join(CURRENT_COLUMNS)} FROM item", "crawl_log")
def item_current(i):
    return _current(i).select(*CURRENT_COLUMNS)


@query("sync_carry_in", with_(FOLD, CURRENT) + f"SELECT {', '.join(CURRENT_COLUMNS)} FROM item", "crawl_log")
def sync_carry_in(i):
    """Two runs, the second on top of the first one's snapshot; the result of one run."""
    log = changes.valid_log(changes.pending_log(i.crawl_log, -1))
    middle = i.table("events").agg(F.floor(F.max("event_id") / 2)).scalar()
    snapshot = saved(changes.current_items(log.where(F.col("log_id") <= middle)))
    return changes.current_items(log.where(F.col("log_id") > middle), snapshot).select(*CURRENT_COLUMNS)


# ---- history --------------------------------------------------------------------------

@query("price_history", with_(FOLD, HISTORY) + "SELECT * FROM hist", "crawl_log")
def price_history(i):
    return changes.new_history(changes.price_history(_changes(i)), None)


@query("items_not_seen", with_(FOLD, CURRENT, SOLD) + f"""
SELECT source_uid, 'sold' AS status, as_of AS sold_dt, 'not_seen_for_{GONE_DAYS}_days' AS sold_reason,
  last_seen_dt FROM gone""", "crawl_log")
def items_not_seen(i):
    return _gone(i).select("source_uid", "status", "sold_dt", "sold_reason", "last_seen_dt")


def _gone(i):
    as_of = i.crawl_log.agg(F.max("dt")).scalar()
    return changes.not_seen(_current(i), as_of, GONE_DAYS)


@query("status_history", with_(FOLD, CURRENT, SOLD) + f"""
SELECT as_of AS dt, source_uid, last_crawl_time AS change_time, 'status' AS change_type, 'active' AS old_value,
  'sold' AS new_value, CAST(NULL AS VARCHAR) AS currency, 'not_seen_for_{GONE_DAYS}_days' AS reason,
  CAST(NULL AS BIGINT) AS log_id, CAST(version AS BIGINT) AS item_version,
  sha256(concat_ws(':', source_uid, 'status', CAST(as_of AS VARCHAR), 'sold')) AS event_key FROM gone""",
       "crawl_log")
def status_history(i):
    return changes.status_history(_gone(i), F.col("last_crawl_time"))


# ---- bookkeeping ----------------------------------------------------------------------

@query("sync_stats", with_(FOLD, HISTORY) + """
SELECT * FROM (SELECT count(*) AS total, count(*) FILTER (trim(category) <> '') AS success,
                 count(*) FILTER (trim(category) = '') AS failed FROM crawl_log WHERE status = 'success') a
JOIN (SELECT count(*) AS price_changed, count(DISTINCT event_key) AS history_written FROM hist) b ON true""",
       "crawl_log")
def sync_stats(i):
    pending, found = changes.pending_log(i.crawl_log, -1), _changes(i)
    return changes.sync_stats(pending, found, changes.new_history(changes.price_history(found), None))


@query("sync_cursor", """
SELECT coalesce(max(log_id), 0) AS "cursor" FROM crawl_log WHERE status = 'success' AND log_id > -1""", "crawl_log")
def sync_cursor(i):
    return changes.next_cursor(changes.pending_log(i.crawl_log, -1))


@query("sync_rejects", """
SELECT log_id, site, category, item_id, 'blank site, category or item_id' AS error
FROM crawl_log WHERE status = 'success' AND trim(category) = ''""", "crawl_log")
def sync_rejects(i):
    return changes.rejected_log(changes.pending_log(i.crawl_log, -1))


GAPS = """
days_seen AS (SELECT DISTINCT uid AS source_uid, dt FROM ok WHERE dt IS NOT NULL),
gaps AS (SELECT *, lead(dt) OVER (PARTITION BY source_uid ORDER BY dt) AS back_dt,
           (SELECT max(dt) FROM days_seen) AS as_of FROM days_seen),
each AS (SELECT *, unnest([0, 1, 7]) AS days FROM gaps)
"""


@query("item_absence", with_(FOLD, GAPS) + """
SELECT CAST(days AS INT) AS days, source_uid, dt AS last_seen_dt, CAST(dt + CAST(days + 1 AS INT) AS DATE) AS gone_dt, back_dt,
  CAST(coalesce(back_dt, as_of) - CAST(dt + CAST(days + 1 AS INT) AS DATE) AS INT) AS n_days
FROM each WHERE dt + CAST(days + 1 AS INT) <= coalesce(back_dt, as_of)""", "crawl_log")
def item_absence(i):
    """Every time an item was not seen for more than 0, 1 and 7 days."""
    return absence.absences(absence.observation_days(_valid(i)), [0, 1, 7])
