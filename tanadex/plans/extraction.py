"""Queries of rule-driven extraction over the page table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tanadex.functions.strategies import STRATEGIES, jsonld_block, jsonld_value, nested_elements
from tanadex.operators import extract, images, quality
from tanadex.operators.scale import dealt, shared_path
from tanadex.plans.registry import query
from tanadex.sources.files import read_jsonl, read_pages, typed_fields, write_jsonl
from tanadex.sources.rules import parse_profile

ANCHOR = r"<a\s[^>]*>.*?</a>"
LINK = {"pattern": ANCHOR, "attr": "href"}
BASE = "https://shop.example"

NAVIGATION = {
    "name": "navigation", "match": {"url_regex": "^https?://"}, "site": "nav.example", "category": "watch",
    "parse": {
        "type": "list", "item_patterns": [r"<section\b.*?</section>", r"<li>.*?</li>"],
        "fields": {
            "product_url": {**LINK, "transforms": [{"type": "url_join", "base": BASE}, {"type": "strip"}]},
            "item_id": {**LINK, "transforms": [
                {"type": "url_join", "base": BASE},
                {"type": "regex_capture", "pattern": "/([^/?#]+)/?$", "group": 1}, {"type": "strip"}]},
            "model_name": {"pattern": ANCHOR, "text": True, "transforms": [{"type": "strip"}]},
        }}}
# Links shortened to their first letter, so that pages hold repeats.
SHORTENED = {**NAVIGATION, "parse": {
    **NAVIGATION["parse"],
    "fields": {**NAVIGATION["parse"]["fields"], "product_url": {
        **LINK, "transforms": [{"type": "regex_capture", "pattern": "^(/.)", "group": 1}]}},
    "post_list_process": [{"method": "deduplicate_by_url", "config": {"url_field": "product_url"}}]}}
ARTICLE = {
    "name": "article", "match": {"url_regex": "^https?://"},
    "parse": {"fields": {
        "title": {"patterns": [r"<h2\b.*?</h2>", r"<title>.*?</title>"], "text": True, "transforms": [{"type": "strip"}]},
        "heading": {"pattern": r"<h1>.*?</h1>", "text": True, "transforms": [{"type": "strip"}]},
        "link": {"pattern": ANCHOR, "attr_candidates": ["data-href", "href"]},
    }}}
CHAINS = {
    "name": "chains", "match": {"url_regex": "^https?://"},
    "fields": {
        "title": [{"type": "regex", "config": {"pattern": "<h2>(.*?)</h2>", "group": 1}},
                  {"type": "tag", "config": {"pattern": "<h1>.*?</h1>"}}],
        "description": [{"type": "regex", "config": {
            "pattern": "<meta name=\"description\" content=\"([^\"]*)\"", "group": 1}}],
        "tracker": [{"type": "regex", "config": {"pattern": r"track\((\d+)\)", "group": 1}}],
    }}

# ---- checks: the same reading with plain text functions ---------------------------------


def plain(markup: str) -> str:
    """Text of a piece of markup for the checking engine."""
    out = f"regexp_replace({markup}, '<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"),
                         ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return out


LINKS = r"""
li AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<li>.*?</li>')) AS li,
         generate_subscripts(regexp_extract_all(html, '(?is)<li>.*?</li>'), 1) - 1 AS pos FROM pages),
link AS (SELECT page_id, url, CAST(pos AS INT) AS pos, regexp_extract(li, '(?is)<a\s[^>]*href="([^"]*)"', 1) AS href, li
         FROM li)
"""
ITEMS = r"""
item AS (SELECT page_id, url, pos, 'https://shop.example' || href AS product_url,
           nullif(regexp_extract(href, '/([^/?#]+)/?$', 1), '') AS item_id, trim(PLAIN) AS model_name FROM link)
""".replace("PLAIN", plain("li"))


def _pages(i):
    return read_pages(i.spark, os.path.join(i.folder, "pages.parquet"))


def _records(i, *rules):
    return extract.extract_records(_pages(i), [parse_profile(r) for r in rules])


def _fields(i, rule, *names):
    return extract.item_fields(extract.explode_items(_records(i, rule)), names)


@query("src_pages", "SELECT page_id, url, length(html) AS n_chars, 200::INT AS status_code FROM pages")
def src_pages(i):
    return _pages(i).select("page_id", "url", F.char_length("html").cast("bigint").alias("n_chars"), "status_code")


SECTIONS = [
    {"name": "spanish", "match": {"url_regex": "/es/", "priority": 5}, "parse": {"fields": {}}},
    {"name": "mobile", "match": {"url_regex": r"^https?://m\.", "priority": 10}, "parse": {"fields": {}}},
    {"name": "shop", "match": {"domains": ["ththre.example.com", "thther.example.org"], "priority": 10},
     "parse": {"fields": {}}},
    {"name": "nothing", "match": {"priority": 99}, "parse": {"fields": {}}},
    {"name": "secure", "match": {"url_regex": "^https://", "priority": 1}, "parse": {"fields": {}}},
]


@query("page_profile_match", r"""
SELECT page_id, CASE WHEN regexp_matches(url, '^https?://m\.') THEN 'mobile'
  WHEN regexp_extract(url, '//([^/?#]*)', 1) IN ('ththre.example.com', 'thther.example.org') THEN 'shop'
  WHEN contains(url, '/es/') THEN 'spanish' WHEN starts_with(url, 'https://') THEN 'secure' END AS profile
FROM pages""")
def page_profile_match(i):
    return extract.match_pages(_pages(i), [parse_profile(p) for p in SECTIONS]).select("page_id", "profile")


@query("extract_list_items", "WITH " + LINKS + ", " + ITEMS + """
SELECT page_id, pos, product_url, item_id, model_name FROM item""")
def extract_list_items(i):
    return _fields(i, NAVIGATION, "product_url", "item_id", "model_name").drop("url", "profile", "site")


@query("extract_single", f"""
SELECT page_id, trim({plain("regexp_extract(html, '(?is)<title>.*?</title>')")}) AS title,
  trim({plain("regexp_extract(html, '(?is)<h1>.*?</h1>')")}) AS heading FROM pages""")
def extract_single(i):
    return _fields(i, ARTICLE, "title", "heading").select("page_id", "title", "heading")


@query("extract_candidates", f"""
SELECT page_id, trim({plain("regexp_extract(html, '(?is)<title>.*?</title>')")}) AS title FROM pages
WHERE NOT regexp_matches(html, '(?i)<h2')""")
def extract_candidates(i):
    return _fields(i, ARTICLE, "title").select("page_id", "title")


@query("extract_attr", r"""
SELECT page_id, replace(nullif(regexp_extract(html, '(?is)<a\s[^>]*href="([^"]*)"', 1), ''), '&amp;', '&') AS link
FROM pages""")
def extract_attr(i):
    return _fields(i, ARTICLE, "link").select("page_id", "link")


@query("extract_strategy_chain", rf"""
SELECT page_id, nullif(trim({plain("regexp_extract(html, '(?is)<h1>.*?</h1>')")}), '') AS title,
  nullif(regexp_extract(html, 'track\(([0-9]+)\)', 1), '') AS tracker FROM pages""")
def extract_strategy_chain(i):
    return _fields(i, CHAINS, "title", "tracker").select("page_id", "title", "tracker")


@query("extract_errors", r"""
SELECT page_id, 'description' AS field, 'no strategy gave a value' AS error FROM pages
  WHERE NOT regexp_matches(html, '<meta name="description" content="[^"]+"')
UNION ALL SELECT page_id, 'tracker', 'no strategy gave a value' FROM pages WHERE NOT regexp_matches(html, 'track\([0-9]+\)')
UNION ALL SELECT page_id, 'title', 'no strategy gave a value' FROM pages WHERE NOT regexp_matches(html, '(?is)<h1>.*?</h1>')""")
def extract_errors(i):
    return _records(i, CHAINS).select("page_id", F.explode("errors").alias("e")).select("page_id", "e.field", "e.error")


@query("extract_regex", r"""
SELECT page_id, nullif(regexp_extract(html, 'track\(([0-9]+)\)', 1), '') AS tracker,
  nullif(regexp_extract(html, '(?i)<HTML lang="[a-z]+"'), '') AS root FROM pages""")
def extract_regex(i):
    regex = STRATEGIES["regex"]
    return i.table("pages").select(
        "page_id", regex(F.col("html"), {"pattern": r"track\((\d+)\)", "group": 1}).alias("tracker"),
        regex(F.col("html"), {"pattern": "<HTML lang=\"[a-z]+\"", "flags": "i", "group": 7}).alias("root"))


@query("extract_tag_text", rf"""
SELECT page_id, nullif(array_to_string([t FOR t IN [trim({plain("a")}) FOR a IN
  regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>')] IF t <> ''], ' '), '') AS links FROM pages""")
def extract_tag_text(i):
    return i.table("pages").select("page_id", STRATEGIES["tag"](F.col("html"), {"pattern": ANCHOR}).alias("links"))


@query("extract_jsonld", """
SELECT p_partkey AS id, p_name AS name, CAST(p_size AS VARCHAR) AS size, p_brand AS brand FROM part""")
def extract_jsonld(i):
    """Pages built from parts: a broken block, then one with the data; every other page holds a list."""
    body = F.to_json(F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_size").alias("size"), F.struct(
        F.col("p_brand").alias("brand")).alias("by")).alias("offer")))
    body = F.when(F.col("p_partkey") % 2 == 0, body).otherwise(F.concat(F.lit("[{\"x\":1}, "), body, F.lit("]")))
    block = F.lit("<script type=\"application/ld+json\">")
    html = F.concat(F.lit("<html>"), block, F.lit("{broken</script><p>x</p>"), block, F.lit("\n"), body,
                    F.lit("\n</script></html>"))
    pages = dealt(i.table("part"), "p_partkey").select(F.col("p_partkey").alias("id"), jsonld_block(html).alias("block"))
    return pages.select("id", *[jsonld_value(F.col("block"), p).alias(n) for n, p in
                                (("name", "name"), ("size", "offer.size"), ("brand", "offer.by.brand"))])


@query("dedup_by_url", "WITH " + LINKS + """
SELECT page_id, short AS product_url, item_id, model_name FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, short ORDER BY pos) AS rn FROM (
    SELECT *, nullif(regexp_extract(href, '^(/.)', 1), '') AS short,
      nullif(regexp_extract(href, '/([^/?#]+)/?$', 1), '') AS item_id, trim(PLAIN) AS model_name FROM link) x
  WHERE short IS NOT NULL) y WHERE rn = 1""".replace("PLAIN", plain("li")))
def dedup_by_url(i):
    return _fields(i, SHORTENED, "product_url", "item_id", "model_name").select(
        "page_id", "product_url", "item_id", "model_name")


@query("normalize_raw_item", """
SELECT p_partkey AS id, 'I' || p_partkey AS item_id, 'N' || p_partkey AS model_no,
  CAST(nullif(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 3 THEN NULL ELSE p_size END, 0) AS INT) AS price,
  CASE p_partkey % 2 WHEN 0 THEN 'USD' ELSE 'JPY' END AS currency, 'watch' AS category, p_brand AS brand_name
FROM part""")
def normalize_raw_item(i):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")

    def only(remainders, value):
        return F.when((key % 4).isin(*remainders), value)

    item = F.map_filter(F.create_map(
        F.lit("item_id"), only((0, 1), F.concat(F.lit("I"), key)), F.lit("id"), only((2, 3), F.concat(F.lit("I"), key)),
        F.lit("model"), F.concat(F.lit("N"), key), F.lit("model_no"), F.lit(""),
        F.lit("price_jpy"), F.when(key % 4 == 0, "0").when(key % 4 == 1, F.concat(F.lit("¥"), size)),
        F.lit("price"), F.when(key % 4 == 2, F.concat(size, F.lit(".9"))).when(key % 4 == 3, "n/a"),
        F.lit("currency"), F.when(key % 2 == 0, "USD"), F.lit("brand_name"), F.col("p_brand")),
        lambda _, v: v.isNotNull())
    rows = i.table("part").select(key.alias("id"), item.alias("item"))
    return extract.normalize_raw_items(rows).select(
        "id", "item_id", "model_no", "price", "currency", "category", "brand_name")


@query("log_append", "WITH " + LINKS + ", " + ITEMS + """
SELECT row_number() OVER (ORDER BY page_id, pos) + 1000 AS log_id, 'watch' AS category, 'nav.example' AS site,
  coalesce(item_id, '') AS item_id, nullif(model_name, '') AS model_name, 'JPY' AS currency, CAST(NULL AS INT) AS price,
  'nav.example:' || coalesce(item_id, '') AS source_uid, 'success' AS status, 200::INT AS http_status,
  url AS fetch_url, product_url, CAST(-1 AS BIGINT) AS run_id, DATE '2024-05-01' AS dt FROM item""")
def log_append(i):
    items = extract.explode_items(_records(i, NAVIGATION))
    at = F.lit("2024-05-01 12:00:00").cast("timestamp")
    return extract.log_rows(items, at, last_log_id=1000).select(
        "log_id", "category", "site", "item_id", "model_name", "currency", "price", "source_uid", "status",
        "http_status", "fetch_url", "product_url", "run_id", "dt")


@query("crawl_summary", "WITH " + LINKS + """
SELECT 'nav.example' AS site, p.url, count(l.pos) AS n_items,
  CAST(CASE WHEN count(l.pos) = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_errors
FROM pages p LEFT JOIN link l ON l.page_id = p.page_id GROUP BY p.url""")
def crawl_summary(i):
    return quality.crawl_summary(_records(i, NAVIGATION))


@query("resource_match", "WITH " + LINKS.strip() + """
, r AS (SELECT page_id, pos, href || CASE WHEN pos % 2 = 0 THEN '?v=1' ELSE '' END AS resource_url FROM link),
w AS (SELECT page_id, pos AS spot, href || '?v=1' AS image_url, href FROM link)
SELECT page_id, spot, image_url, coalesce(
  (SELECT arg_min(resource_url, r.pos) FROM r WHERE r.page_id = w.page_id AND r.resource_url = w.image_url),
  (SELECT arg_min(resource_url, r.pos) FROM r WHERE r.page_id = w.page_id
     AND split_part(split_part(r.resource_url, '?', 1), '#', 1) = split_part(split_part(w.image_url, '?', 1), '#', 1)))
  AS resource_url FROM w""")
def resource_match(i):
    links = _fields(i, {**NAVIGATION, "parse": {**NAVIGATION["parse"], "fields": {"href": LINK}}}, "href")
    found = F.concat("href", F.when(F.col("pos") % 2 == 0, "?v=1").otherwise(""))
    wanted = links.select("page_id", F.col("pos").alias("spot"), F.concat("href", F.lit("?v=1")).alias("image_url"))
    resources = links.select("page_id", "pos", found.alias("resource_url"))
    return images.match_resources(wanted, resources).drop("resource_pos")


@query("jsonl_roundtrip", "WITH " + LINKS + ", " + ITEMS + """
SELECT item.page_id, item.url, pos, product_url, item_id, model_name, CAST(length(p.html) AS INT) AS n_chars
FROM item JOIN pages p ON p.page_id = item.page_id""")
def jsonl_roundtrip(i):
    """Extracted records written as lines without a schema, one field of another type among them, and read by rules."""
    path = shared_path(i.spark)
    records = _records(i, NAVIGATION).join(_pages(i).select("page_id", F.char_length("html").alias("n_chars")), "page_id")
    odd = F.to_json(F.struct("page_id", "url", F.lit("none").alias("n_chars")))
    write_jsonl(records.select("page_id", "url", "items", "errors", "n_chars"), path)
    records.select(odd.alias("value")).write.mode("append").text(path)  # records of the same pages with text for a number
    stored = read_jsonl(i.spark, path).select(*typed_fields(F.col("record"), {
        "page_id": ("$.page_id", "bigint"), "url": ("$.url", "string"), "n_chars": ("$.n_chars", "int"),
        "items": ("$.items", "array<map<string,string>>")})).where(F.col("n_chars").isNotNull())
    return stored.select("page_id", "url", "n_chars", F.posexplode("items").alias("pos", "item")).select(
        "page_id", "url", "pos", *[F.try_element_at("item", F.lit(f)).alias(f) for f in ("product_url", "item_id", "model_name")], "n_chars")


# Page parts laid into elements that hold each other; the last one has no end.
NESTING = """SELECT page_id, '<DIV class="i">' || h || ad || '</div>' AS inside, ad FROM (
  SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h, regexp_extract(html, '<div class="ad">[^<]*</div>', 0) AS ad
  FROM {pages}) p"""


@query("extract_nested_items", "WITH n AS (" + NESTING.replace("{pages}", "pages") + """),
o AS (SELECT *, '<div class="o">x' || inside || '<div>y</div></div >' AS outside FROM n),
e AS (SELECT page_id, unnest([0, 1, 2, 3, 4]) AS pos, unnest([0, 1, 2, 1, 0]) AS level,
  unnest([outside, inside, ad, '<div>y</div>', '<div>z</div>']) AS markup FROM o)
SELECT page_id, CAST(pos AS INT) AS pos, CAST(level AS INT) AS level, markup FROM e""")
def extract_nested_items(i):
    nested = i.spark.sql(NESTING, pages=i.table("pages"))
    html = F.concat(F.lit("<p><div class=\"o\">x"), "inside", F.lit("<div>y</div></div ><divx></p><div>z</div><div>open"))
    found = nested.select("page_id", F.posexplode(nested_elements(html, "div")).alias("pos", "e"))
    return found.select("page_id", "pos", "e.level", "e.markup")
