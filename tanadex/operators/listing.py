"""Listing pages: filtered, sorted, paged items and suggestions by prefix scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tanadex.functions.scalars import display_price
from tanadex.model import list_arguments

# A missing price sorts last when ascending and first when descending.
ORDERS = {
    "price_asc": lambda: [F.col("price").asc_nulls_last(), F.col("id").asc()],
    "price_desc": lambda: [F.col("price").desc_nulls_first(), F.col("id").asc()],
    "first_seen_desc": lambda: [F.col("first_seen_dt").desc_nulls_first(), F.col("id").desc()],
}


def filtered(items: DataFrame, status=None, category=None) -> DataFrame:
    chosen = list_arguments(status=status, category=category)
    rows = items.where(F.col("status") == chosen["status"])
    return rows.where(F.col("category") == chosen["category"]) if chosen["category"] else rows


def list_items(items: DataFrame, page: int = 1, page_size: int = 20, status=None, category=None,
               sort=None) -> DataFrame:
    """One page of items; ties fall back to the id."""
    order = ORDERS[list_arguments(sort=sort)["sort"]]()
    rows = filtered(items, status, category).orderBy(*order)
    return rows.offset((page - 1) * page_size).limit(page_size)


def list_total(items: DataFrame, status=None, category=None) -> DataFrame:
    return filtered(items, status, category).agg(F.count(F.lit(1)).alias("total"))


def item_by_id(items: DataFrame, item_id) -> DataFrame:
    return items.where(F.col("id") == item_id).limit(1)


def recent_log(log: DataFrame, n: int = 5) -> DataFrame:
    return log.orderBy(F.desc("crawl_time"), F.desc("log_id")).limit(n)


def display(items: DataFrame) -> DataFrame:
    """Names as shown: translated where there is a translation; grouped price."""
    return items.withColumns({
        "display_brand": F.coalesce(F.nullif("brand_name_translated", F.lit("")), "brand_name"),
        "display_model": F.coalesce(F.nullif("model_name_translated", F.lit("")), "model_name"),
        "display_price": F.concat_ws(" ", "currency", display_price("price")),
    })


def suggest_union(items: DataFrame, prefix: str, size: int = 5) -> DataFrame:
    """Distinct names and numbers that start with the prefix, case ignored, in order."""
    pattern = prefix.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") + "%"
    scans = [items.select(F.col(c).alias("suggestion")).where(F.col(c).ilike(pattern))
             for c in ("brand_name", "model_name", "model_no")]
    return (reduce(DataFrame.unionByName, scans).distinct().orderBy("suggestion").limit(size))
