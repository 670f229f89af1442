"""Rule-driven extraction: pages in, item records and log rows out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tanadex.functions import scalars
from tanadex.functions.strategies import (STRATEGIES, attribute, attribute_candidates, elements,
                                          text_content)
from tanadex.functions.text import blank_to_null, let
from tanadex.functions.transforms import apply_transforms, java_pattern
from tanadex.model import DEFAULT_CATEGORY, DEFAULT_CURRENCY, LOG_SCHEMA
from tanadex.operators.scale import dense_number
from tanadex.sources.rules import FieldRule, Profile, by_priority

ITEM_TYPE = "map<string,string>"
ERROR_TYPE = "struct<field:string,error:string,strategy:string>"
NO_ITEMS = "no list items found"
NO_VALUE = "no strategy gave a value"

POST_STEPS: dict[str, Callable[[Column, dict], Column]] = {}


def post_step(name: str):
    """Register a step that maps the item array of a page."""
    def register(fn):
        POST_STEPS[name] = fn
        return fn
    return register


def profile_of(url: Column, profiles) -> Column:
    """Name of the first profile, by priority, whose domain or URL pattern fits; else null.

    The rules are a constant of the job, so the choice is one CASE expression.
    """
    host = scalars.network_location(url)
    name = F.lit(None).cast("string")
    for p in reversed(by_priority(profiles)):
        fits = F.lit(False)
        if p.domains:
            fits = fits | host.isin(*p.domains)
        if p.url_regex:
            fits = fits | url.rlike(java_pattern(p.url_regex))
        name = F.when(fits, p.name).otherwise(name)
    return name


def match_pages(pages: DataFrame, profiles) -> DataFrame:
    return pages.withColumn("profile", profile_of(F.col("url"), profiles))


def field_value(markup: Column, rule: FieldRule) -> Column:
    """First value of the field that survives its transforms, over all matching elements."""
    if not rule.patterns:
        return F.lit(None).cast("string")

    def read(element):
        if rule.attr:
            raw = attribute(element, rule.attr)
        elif rule.attr_candidates:
            raw = attribute_candidates(element, rule.attr_candidates)
        else:
            raw = F.lit(None).cast("string")
        if rule.text:
            raw = F.coalesce(raw, text_content(element))
        return apply_transforms(let(raw, blank_to_null), rule.transforms)

    if rule.patterns == (":root",):
        return read(markup)
    values = F.transform(elements(markup, rule.patterns), read)
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def _item(markup: Column, profile: Profile) -> Column:
    values = {name: field_value(markup, rule) for name, rule in profile.fields.items()}
    if profile.category:
        values["category"] = F.lit(profile.category)  # the profile's own category wins over a field of that name
    entries = [e for name, value in values.items() for e in (F.lit(name), value)]
    if not entries:
        return F.create_map().cast(ITEM_TYPE)
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


@post_step("deduplicate_by_url")
def dedup_by_url(items: Column, config: dict | None = None) -> Column:
    """Keep the first item per URL, in page order; items without a URL go too.

    Works inside the page's row: sorted by URL and position, neighbours compared.
    """
    field = (config or {}).get("url_field", "product_url")

    def keep(all_items):
        keyed = F.filter(
            F.transform(all_items, lambda m, i: F.struct(
                F.coalesce(F.try_element_at(m, F.lit(field)), F.lit("")).alias("u"), i.alias("i"))),
            lambda k: k["u"] != "")
        firsts = let(F.array_sort(keyed), lambda s: F.filter(
            s, lambda k, i: (i == 0) | (F.get(s, i - 1)["u"] != k["u"])))
        places = F.array_sort(F.transform(firsts, lambda k: k["i"]))
        return F.transform(places, lambda i: F.get(all_items, i))

    return let(items, keep)


def page_items(html: Column, profile: Profile) -> Column:
    """Array of items of a list page: containers, fields, empty items out, post steps."""
    containers = elements(html, profile.item_patterns) if profile.item_patterns else (
        F.array().cast("array<string>"))
    items = F.filter(F.transform(containers, lambda c: _item(c, profile)), lambda m: F.size(m) > 0)
    for step in profile.post:
        fn = POST_STEPS.get(step["method"])
        items = fn(items, step) if fn else items
    return items


def chain_value(html: Column, chain) -> Column:
    """First non-null value over the strategies of a chain."""
    steps = [STRATEGIES[s["type"]](html, s) for s in chain if s["type"] in STRATEGIES]
    return F.coalesce(*steps) if steps else F.lit(None).cast("string")


def _page_result(html: Column, profile: Profile) -> Column:
    """Struct of items and errors of one page under one profile."""
    no_errors = F.array().cast(f"array<{ERROR_TYPE}>")

    def error(name, text):
        return F.struct(F.lit(name).alias("field"), F.lit(text).alias("error"),
                        F.lit(None).cast("string").alias("strategy")).cast(ERROR_TYPE)

    def result(items, errors):
        return F.struct(items.cast(f"array<{ITEM_TYPE}>").alias("items"), errors.alias("errors"))

    if profile.chains:
        data = F.create_map(*[e for name, chain in profile.chains.items()
                              for e in (F.lit(name), chain_value(html, chain))])
        return let(data, lambda d: result(
            F.array(F.map_filter(d, lambda _, v: v.isNotNull())),
            F.array_compact(F.array(*[F.when(d[name].isNull(), error(name, NO_VALUE))
                                      for name in profile.chains]))))
    if profile.parse_type == "list":
        return let(page_items(html, profile), lambda items: result(
            items, F.when(F.size(items) == 0, F.array(error("items", NO_ITEMS))).otherwise(no_errors)))
    return result(F.array(_item(html, profile)), no_errors)


def extract_records(pages: DataFrame, profiles) -> DataFrame:
    """One record per page that a profile fits: its items and its errors.

    All profiles are evaluated in one pass; only the branch of the page's own
    profile runs. The page text is dropped with this step.
    """
    matched = match_pages(pages, profiles).where(F.col("profile").isNotNull())
    result, site = F.lit(None), F.lit(None).cast("string")
    for p in by_priority(profiles):
        is_p = F.col("profile") == p.name
        result = F.when(is_p, _page_result(F.col("html"), p)).otherwise(result)
        site = F.when(is_p, F.lit(p.site)).otherwise(site)
    site = F.coalesce(site, scalars.site_from_url("url"))
    return (matched.withColumn("result", result)
            .select("page_id", "url", "status_code", "profile", site.alias("site"),
                    F.col("result.items").alias("items"), F.col("result.errors").alias("errors")))


def explode_items(records: DataFrame) -> DataFrame:
    """One row per item with its position on the page."""
    return records.select("page_id", "url", "status_code", "profile", "site",
                          F.posexplode("items").alias("pos", "item"))


def item_fields(items: DataFrame, fields) -> DataFrame:
    """Item map to one string column per field."""
    return items.select("page_id", "url", "profile", "site", "pos",
                        *[F.try_element_at("item", F.lit(f)).alias(f) for f in fields])


def normalize_raw_items(items: DataFrame) -> DataFrame:
    """Columns of the log from an item map: alternative field names, empty text and zero
    prices count as missing."""
    def get(*names):
        return F.coalesce(*[blank_to_null(F.try_element_at("item", F.lit(n))) for n in names])

    def amount(name):
        return F.nullif(F.try_element_at("item", F.lit(name)), F.lit("0"))

    price = scalars.safe_int(F.coalesce(blank_to_null(amount("price_jpy")), blank_to_null(amount("price"))))
    return items.withColumns({
        "item_id": F.coalesce(get("item_id", "id"), F.lit("")),
        "brand_name": get("brand_name"), "model_name": get("model_name"),
        "model_no": get("model_no", "model"), "price": price.try_cast("int"),
        "currency": F.coalesce(get("currency"), F.lit(DEFAULT_CURRENCY)),
        "category": F.coalesce(get("category"), F.lit(DEFAULT_CATEGORY)),
        "product_url": get("product_url"),
    })


def log_rows(items: DataFrame, crawl_time: Column, run_id: int = -1, last_log_id: int = 0) -> DataFrame:
    """Crawl-log rows for extracted items, numbered in page order after the last id.

    Field errors do not fail a row. Image columns are taken over when present.
    """
    rows = normalize_raw_items(items)
    for name in ("image_original_key", "image_thumb_300_key", "image_thumb_600_key", "image_sha256"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    raw = F.to_json("item")
    rows = rows.withColumns({
        "raw_json": raw, "raw_hash": scalars.raw_hash(raw),
        "source_uid": F.concat_ws(":", "site", "item_id"), "status": F.lit("success"),
        "error": F.lit(None).cast("string"), "http_status": F.col("status_code"),
        "fetch_url": F.col("url"), "run_id": F.lit(run_id).cast("bigint"),
        "crawl_time": crawl_time, "dt": crawl_time.cast("date"),
    })
    numbered = dense_number(rows, "page_id", "pos", name="log_id", start=last_log_id + 1)
    return numbered.select(*LOG_SCHEMA.fieldNames())


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("dt").parquet(path)
