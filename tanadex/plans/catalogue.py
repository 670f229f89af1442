"""Queries of listing pages, stored texts and images."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tanadex.operators import images, listing
from tanadex.operators.scale import saved, shared_path
from tanadex.plans.columns import IMAGE_NAME, _image_urls
from tanadex.plans.naming import LISTED, listed
from tanadex.plans.registry import query
from tanadex.sources import files
from tanadex.sources.files import read_key_value_items, write_key_value_text

SHOWN = ("id", "price", "status", "category", "first_seen_dt")
# Rows that an object's lines are packed into.
OBJECT_PARTS = 1024
TEXTS = ("product_url", "brand_name", "model_name", "model_no", "price", "category")


@query("list_items", f"""
SELECT {', '.join(SHOWN)} FROM listing WHERE status = 'active' AND category = 'watch'
ORDER BY price DESC NULLS FIRST, id LIMIT 50 OFFSET 50""", "listing")
def list_items(i):
    return listing.list_items(i.listing, page=2, page_size=50, category="watch", sort="price_desc").select(*SHOWN)


@query("list_total", "SELECT count(*) AS total FROM listing WHERE status = 'active' AND category = 'watch'", "listing")
def list_total(i):
    return listing.list_total(i.listing, category="watch")


@query("item_detail", f"SELECT {', '.join(SHOWN)} FROM listing WHERE id = (SELECT min(id) FROM listing)", "listing")
def item_detail(i):
    return listing.item_by_id(i.listing, i.listing.agg(F.min("id")).scalar()).select(*SHOWN)


@query("display_row", LISTED + """
SELECT id, coalesce(brand_name_translated, brand_name) AS display_brand,
  coalesce(model_name_translated, model_name) AS display_model,
  concat_ws(' ', currency, regexp_replace(reverse(regexp_replace(reverse(CAST(nullif(price, 0) AS VARCHAR)),
    '([0-9]{3})', '\\1,', 'g')), '^,', '')) AS display_price FROM shown""", "listing", "dictionary")
def display_row(i):
    return listing.display(listed(i)).select("id", "display_brand", "display_model", "display_price")


@query("suggest_union", """
SELECT DISTINCT suggestion FROM (SELECT brand_name AS suggestion FROM listing UNION ALL SELECT model_name FROM listing
  UNION ALL SELECT model_no FROM listing) x WHERE suggestion ILIKE 'b%' ORDER BY 1 LIMIT 5""", "listing")
def suggest_union(i):
    return listing.suggest_union(i.listing, "b")


@query("src_kv_text", f"""
SELECT id, {', '.join(f"CAST({c} AS VARCHAR) AS {c}" for c in TEXTS)} FROM listing""", "listing")
def src_kv_text(i):
    """Items written as key/value text and read back."""
    path = shared_path(i.listing.sparkSession)
    write_key_value_text(i.listing.select("site", F.col("id").alias("item_id"), *TEXTS), path)
    back = read_key_value_items(i.listing.sparkSession, path, ("item_id", *TEXTS))
    return back.select(F.col("item_id").cast("long").alias("id"), *TEXTS)


@query("image_keys", f"""
SELECT sha AS image_sha256, min('original/' || sha[1:2] || '/' || sha || '.' || ext) AS image_original_key,
  'thumb/300/' || sha[1:2] || '/' || sha || '.webp' AS image_thumb_300_key,
  'thumb/600/' || sha[1:2] || '/' || sha || '.webp' AS image_thumb_600_key
FROM (SELECT sha256(text) AS sha, CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'webp' ELSE 'jpg' END AS ext
      FROM documents) x GROUP BY sha""")
def image_keys(i):
    """Document texts stand for image bytes."""
    return images.new_images(images.image_keys(_image_urls(i), "text", "image"))


@query("image_missing_keys", """
, k AS (SELECT unnest([image_original_key, image_thumb_300_key, image_thumb_600_key]) AS key FROM crawl_log
        WHERE image_original_key IS NOT NULL),
s AS (SELECT DISTINCT image_original_key AS key FROM crawl_log UNION
      SELECT image_thumb_300_key FROM crawl_log WHERE category = 'watch')
SELECT key, count(*) AS n_rows FROM k WHERE key IS NOT NULL
  AND key NOT IN (SELECT key FROM s WHERE key IS NOT NULL) GROUP BY key""", "crawl_log")
def image_missing_keys(i):
    log = i.crawl_log
    stored = log.select(F.col("image_original_key").alias("key")).unionByName(
        log.where("category = 'watch'").select(F.col("image_thumb_300_key").alias("key")))
    return images.missing_keys(log, stored)


__all__ = ["IMAGE_NAME"]


@query("object_listing", """
SELECT DISTINCT site, CASE WHEN site = 'shop3.example' THEN 0 ELSE 1 END::BIGINT AS n_objects,
  coalesce((SELECT sum(length(CAST(id AS VARCHAR)) + 1) FROM listing w WHERE w.site = l.site AND site <> 'shop3.example'
            AND status <> 'removed'), 0)::BIGINT AS n_bytes FROM listing l""", "listing")
def object_listing(i):
    """Objects and bytes stored below each site's folder; one site has none."""
    path = shared_path(i.spark)
    stored = i.listing.where("status <> 'removed' AND site <> 'shop3.example'").select("site", F.col("id").cast("string").alias("line"))
    # An object is a file, written by one task: lines are packed into few rows, and each site goes to a task of its own.
    packed = (stored.groupBy("site", F.pmod(F.xxhash64("line"), F.lit(OBJECT_PARTS)).alias("part"))
              .agg(F.array_join(F.collect_list("line"), "\n").alias("value")))
    sites = saved(i.listing.select("site").distinct())
    place = sites.select("site", F.row_number().over(W.orderBy("site")).alias("place"))
    (packed.select("site", "value").join(F.broadcast(place), "site").repartitionById(sites.count() + 1, F.col("place"))
     .select("site", "value").write.partitionBy("site").text(path))
    return files.objects_of(sites, files.list_objects(i.spark, path), F.concat(F.lit("site="), "site", F.lit("/")))
