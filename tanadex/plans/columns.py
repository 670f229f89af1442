"""Queries of the scalar columns and value transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tanadex.functions import scalars, text
from tanadex.functions.transforms import apply_transforms
from tanadex.operators import quality
from tanadex.plans.registry import query

# White space for the checking engine, whose \s is ASCII only.
WS = r"[\s\p{Z}\x{85}\x{0b}\x1c-\x1f]"
BASE = "https://commit.example/shop/list?x=1"


def _one(col, **spec):
    return apply_transforms(F.col(col), [spec])


@query("source_uid", """
SELECT log_id, CASE WHEN trim(category) <> '' THEN site || ':' || trim(category) || ':' || item_id END AS source_uid
FROM crawl_log""", "crawl_log")
def source_uid(i):
    return i.crawl_log.select("log_id", scalars.source_uid("site", "category", "item_id").alias("source_uid"))


@query("parse_source_uid", """
SELECT log_id, site, category, item_id || ':x' AS item_id FROM crawl_log""", "crawl_log")
def parse_source_uid(i):
    joined = i.crawl_log.select("log_id", F.concat_ws(":", "site", "category", "item_id", F.lit("x")).alias("uid"))
    return joined.select("log_id", scalars.parse_source_uid("uid").alias("p")).select("log_id", "p.*")


@query("price_event_key", """
SELECT log_id, sha256(site || ':' || category || ':' || item_id || ':price:' || log_id
  || CASE WHEN price IS NULL THEN '' ELSE ':' || price END) AS event_key FROM crawl_log""", "crawl_log")
def price_event_key(i):
    uid = F.concat_ws(":", "site", "category", "item_id")
    return i.crawl_log.select("log_id", scalars.price_event_key(uid, "log_id", "price").alias("event_key"))


@query("status_event_key", """
SELECT log_id, sha256(site || ':' || item_id || ':status:' || strftime(dt, '%Y-%m-%d') || ':' || status) AS event_key
FROM crawl_log""", "crawl_log")
def status_event_key(i):
    uid = F.concat_ws(":", "site", "item_id")
    return i.crawl_log.select("log_id", scalars.status_event_key(uid, "dt", "status").alias("event_key"))


@query("raw_hash", "SELECT log_id, sha256(raw_json) AS raw_hash FROM crawl_log", "crawl_log")
def raw_hash(i):
    return i.crawl_log.select("log_id", scalars.raw_hash("raw_json").alias("raw_hash"))


@query("normalize_price", """
SELECT id, CAST(trunc(try_cast(regexp_replace(txt, '[^0-9.\\-]', '', 'g') AS DOUBLE)) AS BIGINT) AS price
FROM price_texts""", "price_texts")
def normalize_price(i):
    return i.price_texts.select("id", scalars.normalize_price("txt").alias("price"))


@query("price_is_distinct", """
SELECT log_id, price IS DISTINCT FROM nullif(FLOOR(price / 50) * 50, 0) AS changed FROM crawl_log""", "crawl_log")
def price_is_distinct(i):
    coarse = F.nullif((F.floor(F.col("price") / 50) * 50).cast("bigint"), F.lit(0))
    return i.crawl_log.select("log_id", scalars.price_changed("price", coarse).alias("changed"))


@query("safe_int", """
SELECT id, coalesce(CAST(trunc(try_cast(trim(replace(replace(txt, ',', ''), '¥', '')) AS DOUBLE)) AS BIGINT), -1) AS n
FROM price_texts""", "price_texts")
def safe_int(i):
    return i.price_texts.select("id", scalars.safe_int("txt", -1).alias("n"))


@query("format_datetime", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def format_datetime(i):
    return i.table("events").select("event_id", scalars.format_datetime("ts").alias("at"))


@query("coerce_time", """
SELECT event_id, CASE WHEN event_type = 'error' THEN TIMESTAMP '2030-01-01 00:00:00' ELSE ts END AS at,
  CASE WHEN event_type = 'error' THEN DATE '2030-01-01' ELSE CAST(ts AS DATE) END AS dt FROM events""")
def coerce_time(i):
    written = F.when(F.col("event_type") == "error", F.lit("not a time")).when(
        F.col("event_type") == "view", F.concat(F.translate(F.col("ts").cast("string"), " ", "T"), F.lit("Z"))
    ).otherwise(F.col("ts").cast("string"))
    day = F.when(F.col("event_type") == "error", F.lit("2024-13-45")).otherwise(F.to_date("ts").cast("string"))
    run = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    return (i.table("events").select("event_id", written.alias("w"), day.alias("d"))
            .select("event_id", scalars.coerce_timestamp("w", run).alias("at"),
                    scalars.coerce_date("d", run.cast("date")).alias("dt")))


@query("site_from_url", r"""
SELECT page_id, regexp_extract(url, '^https?://([^/:?#]*)', 1) AS site FROM pages""")
def site_from_url(i):
    return i.table("pages").select("page_id", scalars.site_from_url("url").alias("site"))


@query("site_dir", r"""
SELECT page_id, split_part(regexp_extract(url, '^https?://([^/:?#]*)', 1), '.', 1) AS dir,
  regexp_replace(url, '[<>:"/\\|?*]', '_', 'g') AS file FROM pages""")
def site_dir(i):
    return i.table("pages").select("page_id", scalars.site_dir(scalars.site_from_url("url")).alias("dir"),
                                   scalars.safe_name("url").alias("file"))


IMAGE_NAME = """'https://img.example/a.b/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.PNG?v=1.gif' WHEN 1 THEN '.webp'
  WHEN 2 THEN '.tiff' ELSE '' END"""


def _image_urls(i):
    suffix = F.element_at(F.array(F.lit(".PNG?v=1.gif"), F.lit(".webp"), F.lit(".tiff"), F.lit("")),
                          (F.col("doc_id") % 4 + 1).cast("int"))
    return i.table("documents").withColumn("image", F.concat(F.lit("https://img.example/a.b/"), F.col("doc_id"), suffix))


@query("image_ext", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'webp' ELSE 'jpg' END AS ext FROM documents""")
def image_ext(i):
    return _image_urls(i).select("doc_id", scalars.image_type("image").alias("ext"))


@query("image_url", """
SELECT id, 'https://cdn.example/' || image_thumb_300_key AS url FROM listing""", "listing")
def image_url(i):
    return i.listing.select("id", scalars.image_url("image_thumb_300_key", "https://cdn.example/").alias("url"))


# ---- transforms ------------------------------------------------------------------------

@query("tx_url_join", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'https://cdn.example/x/' || page_id
  WHEN 2 THEN 'https://commit.example/p/' || page_id || '?q=1'
  WHEN 3 THEN 'https://commit.example/shop/list?page=' || page_id
  ELSE 'https://commit.example/up/' || page_id END AS url FROM pages""")
def tx_url_join(i):
    key = F.col("page_id").cast("string")
    forms = [F.col("url"), F.concat(F.lit("//cdn.example/x/"), key), F.concat(F.lit("/p/"), key, F.lit("?q=1")),
             F.concat(F.lit("?page="), key), F.concat(F.lit("../up/"), key)]
    raw = i.table("pages").select("page_id", F.element_at(
        F.array(*forms), (F.col("page_id") % 5 + 1).cast("int")).alias("url"))
    return raw.select("page_id", _one("url", type="url_join", base=BASE).alias("url"))


@query("tx_strip", rf"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^{WS}+', ''), '{WS}+$', '')) AS h FROM documents""")
def tx_strip(i):
    padded = i.table("documents").select("doc_id", F.concat(F.lit("　  "), "text", F.lit(" \n　")).alias("t"))
    return padded.select("doc_id", F.md5(_one("t", type="strip")).alias("h"))


@query("tx_regex_capture", r"""
SELECT doc_id, nullif(regexp_extract(text, '([0-9]+)[^0-9]+', 1), '') AS digits FROM documents""")
def tx_regex_capture(i):
    return i.table("documents").select("doc_id", _one(
        "text", type="regex_capture", pattern=r"([0-9]+)[^0-9]+").alias("digits"))


@query("tx_replace", "SELECT doc_id, md5(replace(text, '.', '//')) AS h FROM documents")
def tx_replace(i):
    return i.table("documents").select("doc_id", F.md5(_one(
        "text", type="replace", config={"from": ".", "to": "//"})).alias("h"))


@query("tx_to_int", r"""
SELECT id, CAST(CASE WHEN regexp_matches(regexp_replace(txt, '[,\s]', '', 'g'), '^[+-]?[0-9]+$')
  THEN regexp_replace(txt, '[,\s]', '', 'g') END AS BIGINT) AS n FROM price_texts""", "price_texts")
def tx_to_int(i):
    return i.price_texts.select("id", _one("txt", type="to_int").cast("bigint").alias("n"))


@query("tx_srcset", """
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'b' || p_partkey || '.jpg' WHEN 1 THEN 'c' || p_partkey || '.jpg'
  WHEN 2 THEN 'd' || p_partkey || '.jpg' ELSE 'e.jpg' END AS url FROM part""")
def tx_srcset(i):
    key = F.col("p_partkey").cast("string")
    forms = [F.concat(F.lit("a.jpg 300w, b"), key, F.lit(".jpg 600w")),
             F.concat(F.lit("c"), key, F.lit(".jpg 2x, x.jpg 1x")),
             F.concat(F.lit("d"), key, F.lit(".jpg 1.5x , x.jpg 0.5x")), F.lit("e.jpg")]
    raw = i.table("part").select(F.col("p_partkey").alias("id"), F.element_at(
        F.array(*forms), (F.col("p_partkey") % 4 + 1).cast("int")).alias("s"))
    return raw.select("id", _one("s", type="pick_best_srcset").alias("url"))


# ---- language ---------------------------------------------------------------------------

@query("detect_language", r"""
SELECT id, CASE WHEN regexp_matches(model_name, '[\x{4e00}-\x{9fff}]') THEN 'zh'
  WHEN regexp_matches(model_name, '[\x{3040}-\x{30ff}]') THEN 'ja' ELSE 'en' END AS lang
FROM (SELECT id, model_name FROM catalog UNION ALL SELECT doc_id, text FROM documents
      UNION ALL SELECT id, model_name FROM listing) x""", "catalog", "listing")
def detect_language(i):
    texts = (i.catalog.select("id", "model_name")
             .unionAll(i.table("documents").select("doc_id", "text")).unionAll(i.listing.select("id", "model_name")))
    return texts.select("id", text.detect_language("model_name").alias("lang"))


@query("product_language", r"""
SELECT id, CASE WHEN regexp_matches(brand_name || model_name, '[\x{4e00}-\x{9fff}]') THEN 'zh'
  WHEN regexp_matches(brand_name || model_name, '[\x{3040}-\x{30ff}]') THEN 'ja' ELSE 'en' END AS lang
FROM catalog""", "catalog")
def product_language(i):
    return i.catalog.select("id", text.product_language("brand_name", "model_name").alias("lang"))


@query("needs_translation", r"""
SELECT id, NOT regexp_matches(brand_name, '[\x{3040}-\x{30ff}]') AS to_ja,
  regexp_matches(brand_name, '[\x{3040}-\x{30ff}]') AS to_en FROM catalog""", "catalog")
def needs_translation(i):
    return i.catalog.select("id", text.needs_translation("brand_name", "ja").alias("to_ja"),
                            text.needs_translation("brand_name", "en").alias("to_en"))


# ---- quality -----------------------------------------------------------------------------

@query("validate_fields", r"""
SELECT id, trim(txt) <> '' AS filled,
  regexp_matches(trim(replace(txt, ',', '')), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$') AS number,
  trim(txt) <> '' AS text, regexp_matches(txt, '^/') AS url FROM price_texts""", "price_texts")
def validate_fields(i):
    return i.price_texts.select("id", *[quality.validator(k)(F.col("txt")).alias(n)
                                        for k, n in enumerate(("filled", "number", "text", "url"))])


CHECKS_OF_FIELDS = {"price": (1, 0.97), "product_url": (3, 0.9), "model_no": (2, 0.95)}
COMPLETENESS = """
report AS (
  SELECT 'brand_name' AS field, avg((trim(brand_name) <> '')::INT) AS completeness, 0.9::DOUBLE AS threshold, 0 AS type FROM listing
  UNION ALL SELECT 'price', avg((price IS NOT NULL)::INT), 0.97::DOUBLE, 1 FROM listing
  UNION ALL SELECT 'product_url', avg((product_url LIKE 'https://_%')::INT), 0.9::DOUBLE, 3 FROM listing
  UNION ALL SELECT 'model_no', avg((model_no IS NOT NULL)::INT), 0.95::DOUBLE, 2 FROM listing)
"""


def _report(i):
    return quality.completeness(i.listing, ("brand_name", *CHECKS_OF_FIELDS), CHECKS_OF_FIELDS)


@query("completeness", ", " + COMPLETENESS + """
SELECT field, round(completeness, 9) AS completeness, threshold, type FROM report""", "listing")
def completeness(i):
    return _report(i).withColumn("completeness", F.round("completeness", 9))


@query("completeness_failed", ", " + COMPLETENESS + """
SELECT field, round(completeness, 9) AS completeness, threshold, type FROM report WHERE completeness < threshold""",
       "listing")
def completeness_failed(i):
    return quality.failed_fields(_report(i)).withColumn("completeness", F.round("completeness", 9))
