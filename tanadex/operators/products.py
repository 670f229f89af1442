"""Canonical products: items with the same normalised names are one product."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tanadex.model import DEFAULT_CATEGORY
from tanadex.operators.names import normalize_items
from tanadex.operators.scale import quantile_number, saved
from tanadex.sources.dictionary import AliasDictionary

KEY = ("category", "brand_std", "model_std", "model_no_std")
PRODUCT_NAMES = ("category", "brand_name", "model_name", "model_no")


def unlinked(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Items without a product; a limit takes the lowest ids, complete or not."""
    rows = items.where(F.col("product_id").isNull())
    return rows.orderBy("id").limit(limit) if limit else rows


def keyed_items(items: DataFrame, dictionary: AliasDictionary) -> DataFrame:
    """Normalised names plus whether all three are present."""
    named = normalize_items(
        items.withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit(DEFAULT_CATEGORY))),
        dictionary)
    complete = (F.col("brand_std") != "") & (F.col("model_std") != "") & (F.col("model_no_std") != "")
    return named.withColumn("complete", complete)


def new_products(keyed: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Products not yet known, numbered in order of their lowest item id."""
    groups = (keyed.where("complete").groupBy(*KEY).agg(F.min("id").alias("first_item"))
              .withColumnsRenamed(dict(zip(KEY, PRODUCT_NAMES, strict=True))))
    if existing is None:
        return quantile_number(saved(groups), "first_item", name="id").select("id", *PRODUCT_NAMES)
    groups = groups.join(existing.select(*PRODUCT_NAMES), list(PRODUCT_NAMES), "left_anti")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    numbered = quantile_number(saved(groups), "first_item", name="no")
    return numbered.select((F.col("no") + top).alias("id"), *PRODUCT_NAMES)


def all_products(keyed: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    fresh = new_products(keyed, existing)
    return fresh if existing is None else existing.select("id", *PRODUCT_NAMES).unionByName(fresh)


def link_items(keyed: DataFrame, products: DataFrame) -> DataFrame:
    """``id, product_id`` of complete items.

    A product with very many items is the skewed side; adaptive execution splits it,
    and the product side is joined by broadcast when it turns out small.
    """
    named = products.select(F.col("id").alias("product_id"),
                            *[F.col(n).alias(k) for k, n in zip(KEY, PRODUCT_NAMES, strict=True)])
    return keyed.where("complete").select("id", *KEY).join(named, list(KEY)).select("id", "product_id")


def aggregate_items(items: DataFrame, dictionary: AliasDictionary, existing: DataFrame | None = None,
                    limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(products, links) for the items not yet linked."""
    keyed = keyed_items(unlinked(items, limit), dictionary)
    products = all_products(keyed, existing)
    return products, link_items(keyed, products)


def aggregate_item(items: DataFrame, item_id: int, dictionary: AliasDictionary,
                   existing: DataFrame | None = None) -> DataFrame:
    """``id, product_id`` for one item; an item already linked keeps its product."""
    one = items.where(F.col("id") == item_id)
    linked = one.where(F.col("product_id").isNotNull()).select("id", "product_id")
    return linked.unionByName(aggregate_items(one, dictionary, existing)[1])


def product_stats(items: DataFrame, dictionary: AliasDictionary, limit: int | None = None) -> DataFrame:
    keyed = keyed_items(unlinked(items, limit), dictionary)
    return keyed.agg(F.count(F.lit(1)).alias("processed"),
                     F.count_if("complete").alias("success"),
                     F.lit(0).cast("bigint").alias("failed"),
                     F.count_if(~F.col("complete")).alias("skipped"))
