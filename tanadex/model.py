"""Schemas and value sets shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The value sets and defaults of the data model.
CATEGORIES = ("watch", "bag", "jewelry", "clothing", "camera")
DEFAULT_CATEGORY = "watch"
ITEM_STATUSES = ("active", "sold", "removed")
DEFAULT_STATUS = "active"
CHANGE_TYPES = ("price", "status")
LOG_STATUSES = ("success", "failed")
LANGUAGES = ("en", "zh", "ja")
DEFAULT_LANGUAGE = "en"
LIST_SORTS = ("first_seen_desc", "price_asc", "price_desc")
DEFAULT_LIST_SORT = "first_seen_desc"
SEARCH_SORT_FIELDS = ("price", "last_seen_dt", "created_at")
SEARCH_SORT_ORDERS = ("asc", "desc")
CURRENCIES = ("JPY", "USD", "CNY")
DEFAULT_CURRENCY = "JPY"
MAX_PAGE_SIZE = 100

PRICE_REASON = "crawler_update"

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
])

LOG_SCHEMA = T.StructType([
    T.StructField("log_id", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("site", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("raw_json", T.StringType()),
    T.StructField("brand_name", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("model_no", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("price", T.IntegerType()),
    T.StructField("image_original_key", T.StringType()),
    T.StructField("image_thumb_300_key", T.StringType()),
    T.StructField("image_thumb_600_key", T.StringType()),
    T.StructField("image_sha256", T.StringType()),
    T.StructField("source_uid", T.StringType()),
    T.StructField("raw_hash", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("http_status", T.IntegerType()),
    T.StructField("fetch_url", T.StringType()),
    T.StructField("product_url", T.StringType()),
    T.StructField("run_id", T.LongType()),
    T.StructField("crawl_time", T.TimestampType()),
    T.StructField("dt", T.DateType()),
])

ITEM_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("source_uid", T.StringType()),
    T.StructField("site", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("brand_name", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("model_no", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("price", T.LongType()),
    T.StructField("image_sha256", T.StringType()),
    T.StructField("image_original_key", T.StringType()),
    T.StructField("image_thumb_300_key", T.StringType()),
    T.StructField("image_thumb_600_key", T.StringType()),
    T.StructField("product_url", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("first_seen_dt", T.DateType()),
    T.StructField("last_seen_dt", T.DateType()),
    T.StructField("sold_dt", T.DateType()),
    T.StructField("sold_reason", T.StringType()),
    T.StructField("last_crawl_time", T.TimestampType()),
    T.StructField("last_log_id", T.LongType()),
    T.StructField("price_last_changed_at", T.TimestampType()),
    T.StructField("price_last_changed_dt", T.DateType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

HISTORY_COLUMNS = (
    "dt", "source_uid", "change_time", "change_type", "old_value", "new_value",
    "currency", "reason", "log_id", "item_version", "event_key",
)

DICTIONARY_SCHEMA = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("brand_ord", T.LongType()),
    T.StructField("brand", T.StringType()),
    T.StructField("model_ord", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("alias_ord", T.LongType()),
    T.StructField("alias", T.StringType()),
])

TRANSLATION_TYPE = T.StructType([
    T.StructField("en", T.StringType()),
    T.StructField("zh", T.StringType()),
    T.StructField("ja", T.StringType()),
    T.StructField("en_variants", T.ArrayType(T.StringType())),
])


def checked(value, allowed, fallback):
    """``value`` when it is one of ``allowed``, otherwise ``fallback``."""
    return value if value in allowed else fallback


def list_arguments(status=None, category=None, lang=None, sort=None):
    """Listing pages: bad or missing status means active, bad category means none."""
    return {
        "status": checked(status, ITEM_STATUSES, DEFAULT_STATUS),
        "category": checked(category, CATEGORIES, None),
        "lang": checked(lang, LANGUAGES, DEFAULT_LANGUAGE),
        "sort": checked(sort, LIST_SORTS, DEFAULT_LIST_SORT),
    }


def search_arguments(status=None, category=None, currency=None, lang=None,
                     sort_field=None, sort_order=None):
    """Search: a bad status, category or currency means no filter at all."""
    return {
        "status": checked(status, ITEM_STATUSES, None),
        "category": checked(category, CATEGORIES, None),
        "currency": checked(currency, CURRENCIES, None),
        "lang": checked(lang, LANGUAGES, DEFAULT_LANGUAGE),
        "sort_field": checked(sort_field, SEARCH_SORT_FIELDS, "last_seen_dt") if sort_field else None,
        "sort_order": checked(sort_order, SEARCH_SORT_ORDERS, "desc"),
    }
