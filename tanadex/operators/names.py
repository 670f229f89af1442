"""Canonical brand and model names, product keys and alias lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tanadex.functions.text import (lower_key, match_key, normalize_model_no, strip)
from tanadex.sources.dictionary import AliasDictionary


def _name(col: str):
    return strip(F.coalesce(F.col(col), F.lit("")))


def canonical_brand(items: DataFrame, dictionary: AliasDictionary, brand: str = "brand_name",
                    to: str = "brand_std") -> DataFrame:
    """Add the dictionary's brand for each spelling, else the trimmed spelling.

    An exact alias of any brand beats a case-insensitive one, which beats one that
    only agrees after folding: three hash lookups, one row out per row in.
    """
    keyed = items.withColumn("key_exact", _name(brand)).withColumn("key_lower", lower_key("key_exact"))
    found = (keyed.join(dictionary.brand_lookup("exact"), ["category", "key_exact"], "left")
             .join(dictionary.brand_lookup("lower"), ["category", "key_lower"], "left"))
    open_name = F.when(F.coalesce("brand_exact", "brand_lower").isNull() & (F.col("key_exact") != ""),
                       F.col("key_exact"))
    found = (found.withColumn("key_folded", F.when(open_name.isNotNull(), match_key(open_name)))
             .join(dictionary.brand_lookup("folded"), ["category", "key_folded"], "left"))
    chosen = F.coalesce("brand_exact", "brand_lower", "brand_folded", "key_exact")
    return found.select(*[F.col(c) for c in items.columns if c != to], chosen.alias(to))


def canonical_model(items: DataFrame, dictionary: AliasDictionary, brand_std: str = "brand_std",
                    model: str = "model_name", to: str = "model_std") -> DataFrame:
    """Add the dictionary's model within the canonical brand, else the trimmed spelling."""
    keyed = (items.withColumn("lookup_brand", F.col(brand_std)).withColumn("key_exact", _name(model))
             .withColumn("key_lower", lower_key("key_exact")))
    on = ["category", "lookup_brand"]
    found = (keyed.join(dictionary.model_lookup("exact"), [*on, "key_exact"], "left")
             .join(dictionary.model_lookup("lower"), [*on, "key_lower"], "left"))
    open_name = F.when(F.coalesce("model_exact", "model_lower").isNull() & (F.col("key_exact") != ""),
                       F.col("key_exact"))
    found = (found.withColumn("key_folded", F.when(open_name.isNotNull(), match_key(open_name)))
             .join(dictionary.model_lookup("folded"), [*on, "key_folded"], "left"))
    chosen = F.coalesce("model_exact", "model_lower", "model_folded", "key_exact")
    return found.select(*[F.col(c) for c in items.columns if c != to], chosen.alias(to))


def normalize_items(items: DataFrame, dictionary: AliasDictionary) -> DataFrame:
    """Add ``brand_std``, ``model_std`` and ``model_no_std``."""
    named = canonical_model(canonical_brand(items, dictionary), dictionary)
    return named.withColumn("model_no_std", normalize_model_no("model_no"))


def product_key():
    """``category|brand|model|no`` over normalised columns."""
    return F.concat_ws("|", "category", "brand_std", "model_std", "model_no_std")


def match_products(pairs: DataFrame, items: DataFrame, dictionary: AliasDictionary) -> DataFrame:
    """For given (id_a, id_b) pairs: do both items normalise to the same product?"""
    keyed = normalize_items(items, dictionary).select("id", product_key().alias("key"))
    return (pairs
            .join(keyed.select(F.col("id").alias("id_a"), F.col("key").alias("key_a")), "id_a")
            .join(keyed.select(F.col("id").alias("id_b"), F.col("key").alias("key_b")), "id_b")
            .select("id_a", "id_b", (F.col("key_a") == F.col("key_b")).alias("same_product")))


def _alias_lists(rows: DataFrame, keys: list[str], to: str) -> DataFrame:
    """First-wins, case-insensitive alias list per key, in dictionary order.

    Groups are one dictionary entry each, so the list is as short as the entry.
    """
    trimmed = rows.withColumn("alias", strip("alias")).where(F.col("alias") != "")
    firsts = (trimmed.groupBy(*keys, F.lower("alias").alias("_lower"))
              .agg(F.min(F.struct("alias_ord", "alias")).alias("_first")))
    return (firsts.groupBy(*keys).agg(F.array_sort(F.collect_list("_first")).alias("_list"))
            .select(*keys, F.transform("_list", lambda a: a["alias"]).alias(to)))


def brand_alias_lists(dictionary: AliasDictionary) -> DataFrame:
    return _alias_lists(dictionary.brand_rows, ["category", "brand"], "brand_aliases")


def model_alias_lists(dictionary: AliasDictionary) -> DataFrame:
    return _alias_lists(dictionary.model_rows, ["category", "brand", "model"], "model_aliases")
