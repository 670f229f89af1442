"""Content-addressed image catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tanadex.functions.scalars import image_type, original_key, thumb_key

KEY_COLUMNS = ("image_original_key", "image_thumb_300_key", "image_thumb_600_key")


def image_keys(images: DataFrame, content: str = "content", url: str = "path") -> DataFrame:
    """Hash of the bytes and the three object keys; content itself is dropped."""
    hashed = images.select(F.sha2(F.col(content).cast("binary"), 256).alias("image_sha256"),
                           image_type(url).alias("suffix"))
    return hashed.select(
        "image_sha256", original_key("image_sha256", "suffix").alias("image_original_key"),
        thumb_key("image_sha256", 300).alias("image_thumb_300_key"),
        thumb_key("image_sha256", 600).alias("image_thumb_600_key"))


def new_images(keys: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per content that is not yet stored; the smallest key wins equal content."""
    firsts = (keys.groupBy("image_sha256")
              .agg(*[F.min(c).alias(c) for c in KEY_COLUMNS]))
    if stored is None:
        return firsts
    known = stored.select(F.col("key").alias("image_original_key"))
    return firsts.join(known, "image_original_key", "left_anti").select("image_sha256", *KEY_COLUMNS)


def missing_keys(log: DataFrame, stored: DataFrame) -> DataFrame:
    """Referenced keys with no object, and how many rows refer to them."""
    wanted = (log.where(F.col("image_original_key").isNotNull())
              .select(F.explode(F.array_compact(F.array(*KEY_COLUMNS))).alias("key"))
              .groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")))
    return wanted.join(stored.select("key").distinct(), "key", "left_anti")


def match_resources(wanted: DataFrame, resources: DataFrame) -> DataFrame:
    """For each (page_id, image_url): the page's resource with that URL, else with the
    same address ignoring query and fragment; the first resource wins.

    ``resources`` has page_id, pos, resource_url.
    """
    bare = F.regexp_replace
    exact = (resources.groupBy("page_id", F.col("resource_url").alias("image_url"))
             .agg(F.min("pos").alias("exact_pos")))
    by_address = (resources.groupBy("page_id", bare("resource_url", "[?#].*$", "").alias("address"))
                  .agg(F.min_by("resource_url", "pos").alias("near_url"), F.min("pos").alias("near_pos")))
    return (wanted.withColumn("address", bare("image_url", "[?#].*$", ""))
            .join(exact, ["page_id", "image_url"], "left")
            .join(by_address, ["page_id", "address"], "left")
            .select(*wanted.columns,
                    F.when(F.col("exact_pos").isNotNull(), F.col("image_url"))
                    .otherwise(F.col("near_url")).alias("resource_url"),
                    F.coalesce("exact_pos", "near_pos").alias("resource_pos")))
