"""Scalar columns of the listing model: keys, prices, times, image names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tanadex.functions.text import SPACES, blank_to_null, strip, text_column

# Accepted image file types and the one assumed otherwise.
IMAGE_TYPES = ("jpg", "jpeg", "png", "gif", "webp", "bmp")
DEFAULT_IMAGE_TYPE = "jpg"


def source_uid(site, category, item_id) -> Column:
    """``site:category:item_id``; null when any part is blank."""
    parts = [blank_to_null(strip(text_column(c).cast("string")))
             for c in (site, category, item_id)]
    complete = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when(complete, F.concat_ws(":", *parts))


def parse_source_uid(uid) -> Column:
    """Struct of site, category, item_id; null unless there are three parts."""
    parts = F.split(text_column(uid), ":", 3)
    return F.when(F.size(parts) == 3, F.struct(
        F.get(parts, F.lit(0)).alias("site"),
        F.get(parts, F.lit(1)).alias("category"),
        F.get(parts, F.lit(2)).alias("item_id")))


def price_event_key(uid, log_id, new_price) -> Column:
    """``concat_ws`` skips a null price, which is exactly the key's rule."""
    return F.sha2(F.concat_ws(":", text_column(uid), F.lit("price"),
                              text_column(log_id).cast("string"),
                              text_column(new_price).cast("string")), 256)


def status_event_key(uid, on_date, status) -> Column:
    return F.sha2(F.concat_ws(":", text_column(uid), F.lit("status"),
                              text_column(on_date).cast("string"),
                              text_column(status)), 256)


def raw_hash(raw_json) -> Column:
    return F.sha2(text_column(raw_json), 256)


def normalize_price(col) -> Column:
    """Text to whole currency units: every character but digits, dot and minus is dropped."""
    kept = F.regexp_replace(text_column(col).cast("string"), r"(?U)[^\d.\-]", "")
    number = kept.try_cast("double")
    return F.when(~F.isnan(number), number.try_cast("bigint"))


def normalize_price_typed(col, data_type: str) -> Column:
    """Integers as they are, fractions truncated toward zero, text parsed."""
    if data_type in ("int", "bigint", "smallint", "tinyint"):
        return text_column(col).cast("bigint")
    if data_type in ("double", "float") or data_type.startswith("decimal"):
        return text_column(col).try_cast("bigint")
    return normalize_price(col)


def price_changed(old, new) -> Column:
    """IS DISTINCT FROM."""
    return ~text_column(old).eqNullSafe(text_column(new))


def safe_int(col, default: int | None = None) -> Column:
    cleaned = strip(F.regexp_replace(text_column(col).cast("string"), "[,¥]", ""))
    number = cleaned.try_cast("double")
    parsed = F.when(~F.isnan(number), number.try_cast("bigint"))
    return F.coalesce(parsed, F.lit(default).cast("bigint"))


def format_datetime(col) -> Column:
    return F.date_format(text_column(col), "yyyy-MM-dd HH:mm:ss")


def coerce_timestamp(col, run_time: Column) -> Column:
    """ISO text to a timestamp without zone; unparsable becomes the run time."""
    text = F.regexp_replace(text_column(col).cast("string"), "Z$", "")
    return F.coalesce(text.try_cast("timestamp_ntz"), run_time)


def coerce_date(col, run_date: Column) -> Column:
    text = text_column(col).cast("string")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    return F.coalesce(iso.try_cast("date"), run_date)


def network_location(url) -> Column:
    """Host part of a URL, port and credentials kept; empty when there is none."""
    return F.regexp_extract(text_column(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def site_from_url(url) -> Column:
    """Host without port; for text without a host, its first path segment."""
    url = text_column(url)
    host = blank_to_null(network_location(url))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#/]*)", 1)
    return F.coalesce(F.split(F.coalesce(host, path), ":", 2)[0], F.lit("unknown"))


def image_type(url) -> Column:
    """Lower-case suffix of the URL's path when it is a known image type, else jpg."""
    path = F.regexp_replace(F.regexp_replace(text_column(url), r"[?#].*$", ""),
                            r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/]*", "")
    suffix = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    return F.when(suffix.isin(*IMAGE_TYPES), suffix).otherwise(F.lit(DEFAULT_IMAGE_TYPE))


def original_key(sha, suffix) -> Column:
    sha = text_column(sha)
    return F.concat(F.lit("original/"), F.substring(sha, 1, 2), F.lit("/"), sha,
                    F.lit("."), text_column(suffix))


def thumb_key(sha, size: int) -> Column:
    sha = text_column(sha)
    return F.concat(F.lit(f"thumb/{size}/"), F.substring(sha, 1, 2), F.lit("/"), sha,
                    F.lit(".webp"))


def image_url(key, base: str) -> Column:
    key = blank_to_null(key)
    return F.concat(F.lit(base.rstrip("/") + "/"), key)


def safe_name(col) -> Column:
    """File-name form: characters that file systems refuse become underscores."""
    return F.regexp_replace(text_column(col), r'[<>:"/\\|?*]', "_")


def site_dir(site) -> Column:
    return safe_name(F.substring_index(text_column(site), ".", 1))


def display_price(price) -> Column:
    return F.format_number(F.nullif(text_column(price), F.lit(0)), 0)


def collapse_spaces(col) -> Column:
    return F.regexp_replace(text_column(col), SPACES, "")
