"""Queries of names, products, translations and titles."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tanadex.functions import text
from tanadex.operators import extract, names, products, titles, translate
from tanadex.operators.scale import saved
from tanadex.plans.extraction import plain
from tanadex.plans.inputs import FULL, HALF, ID_STEP
from tanadex.plans.registry import query
from tanadex.sources.dictionary import AliasDictionary
from tanadex.sources.files import read_pages
from tanadex.sources.rules import parse_profile


def dictionary_of(i) -> AliasDictionary:
    """The dictionary is used by many lookups, so it is derived once and stored."""
    return AliasDictionary(saved(i.dictionary))


def folded(col: str) -> str:
    """Folding of a name for the checking engine; covers the characters of the inputs."""
    return (rf"regexp_replace(translate({col}, '{FULL}', '{HALF}'), '[\s,.・。、，·•‧∙\x{{3000}}\x{{A0}}]', '', 'g')")


CANON = rf"""
bk AS (SELECT alias, lower(trim(alias)) AS lk, lower({folded('alias')}) AS nk, brand, brand_ord
       FROM dictionary WHERE model IS NULL),
b1 AS (SELECT alias AS k, arg_min(brand, brand_ord) AS b FROM bk GROUP BY alias),
b2 AS (SELECT lk AS k, arg_min(brand, brand_ord) AS b FROM bk GROUP BY lk),
b3 AS (SELECT nk AS k, arg_min(brand, brand_ord) AS b FROM bk GROUP BY nk),
mk AS (SELECT alias, lower(trim(alias)) AS lk, lower({folded('alias')}) AS nk, brand, model, model_ord
       FROM dictionary WHERE model IS NOT NULL),
m1 AS (SELECT brand, alias AS k, arg_min(model, model_ord) AS m FROM mk GROUP BY brand, alias),
m2 AS (SELECT brand, lk AS k, arg_min(model, model_ord) AS m FROM mk GROUP BY brand, lk),
m3 AS (SELECT brand, nk AS k, arg_min(model, model_ord) AS m FROM mk GROUP BY brand, nk),
branded AS (
  SELECT t.*, coalesce(b1.b, b2.b, b3.b, trim(brand_name)) AS brand_std FROM ITEMS t
  LEFT JOIN b1 ON category = 'watch' AND b1.k = trim(brand_name)
  LEFT JOIN b2 ON category = 'watch' AND b2.k = lower(trim(brand_name))
  LEFT JOIN b3 ON category = 'watch' AND b3.k = lower({folded('brand_name')})),
named AS (
  SELECT t.*, coalesce(m1.m, m2.m, m3.m, trim(model_name)) AS model_std,
    coalesce(upper(regexp_replace(model_no, '\s', '', 'g')), '') AS model_no_std FROM branded t
  LEFT JOIN m1 ON category = 'watch' AND m1.brand = brand_std AND m1.k = trim(model_name)
  LEFT JOIN m2 ON category = 'watch' AND m2.brand = brand_std AND m2.k = lower(trim(model_name))
  LEFT JOIN m3 ON category = 'watch' AND m3.brand = brand_std AND m3.k = lower({folded('model_name')}))
"""
KANA, HAN = r"[\x{3040}-\x{30ff}]", r"[\x{4e00}-\x{9fff}]"


def language_of(name: str) -> str:
    return (f"CASE WHEN regexp_matches({name}, '{HAN}') THEN 'zh' WHEN regexp_matches({name}, '{KANA}') "
            "THEN 'ja' ELSE 'en' END")


def canon(items: str) -> str:
    return ", " + CANON.replace("ITEMS", items).strip() + " "


TRANSLATIONS = f"""
tr AS (SELECT brand AS brand_name, coalesce(model, '') AS model_name, coalesce(model, brand) AS en,
    arg_min(alias, alias_ord) FILTER (alias_ord > 0 AND regexp_matches(alias, '{HAN}')
                                      AND NOT regexp_matches(alias, '{KANA}')) AS zh,
    arg_min(alias, alias_ord) FILTER (alias_ord > 0 AND regexp_matches(alias, '{KANA}')) AS ja,
    string_agg(alias, '|' ORDER BY alias_ord) FILTER (alias_ord > 0 AND NOT regexp_matches(alias, '{HAN}|{KANA}')
      AND lower(alias) <> lower(coalesce(model, brand))) AS en_variants
  FROM dictionary GROUP BY brand, model)
"""


@query("normalize_text", f"""
SELECT id, {folded('brand_name')} AS brand_key, {folded('model_name')} AS model_key FROM listing""", "listing")
def normalize_text(i):
    return i.listing.select("id", text.normalize_text("brand_name").alias("brand_key"),
                            text.normalize_text("model_name").alias("model_key"))


@query("model_no_norm", r"""
SELECT id, coalesce(upper(regexp_replace(model_no, '\s', '', 'g')), '') AS model_no_std FROM listing""", "listing")
def model_no_norm(i):
    return i.listing.select("id", text.normalize_model_no("model_no").alias("model_no_std"))


@query("brand_canonical", canon("listing") + "SELECT id, brand_std FROM branded", "listing", "dictionary")
def brand_canonical(i):
    return names.canonical_brand(i.listing, dictionary_of(i)).select("id", "brand_std")


@query("model_canonical", canon("listing") + "SELECT id, brand_std, model_std FROM named", "listing", "dictionary")
def model_canonical(i):
    d = dictionary_of(i)
    return names.canonical_model(names.canonical_brand(i.listing, d), d).select("id", "brand_std", "model_std")


@query("normalize_item", canon("listing") + "SELECT id, brand_std, model_std, model_no_std FROM named",
       "listing", "dictionary")
def normalize_item(i):
    return names.normalize_items(i.listing, dictionary_of(i)).select("id", "brand_std", "model_std", "model_no_std")


@query("product_key", canon("listing") + """
SELECT id, category || '|' || brand_std || '|' || model_std || '|' || model_no_std AS key FROM named""",
       "listing", "dictionary")
def product_key(i):
    return names.normalize_items(i.listing, dictionary_of(i)).select("id", names.product_key().alias("key"))


@query("match_products", canon("listing") + f"""
, keyed AS (SELECT id, concat_ws('|', category, brand_std, model_std, model_no_std) AS key FROM named)
SELECT a.id AS id_a, b.id AS id_b, a.key = b.key AS same_product FROM keyed a JOIN keyed b ON b.id = a.id + {ID_STEP}""",
       "listing", "dictionary")
def match_products(i):
    """Pairs of neighbouring order lines."""
    ids = i.listing.select("id")
    pairs = ids.select(F.col("id").alias("id_a"), (F.col("id") + ID_STEP).alias("id_b")).join(
        ids.withColumnRenamed("id", "id_b"), "id_b", "left_semi")
    return names.match_products(pairs, i.listing, dictionary_of(i))


# ---- products ---------------------------------------------------------------------------

PRODUCTS = """
, prod AS (SELECT row_number() OVER (ORDER BY min(id)) AS product_id, category, brand_std, model_std, model_no_std
  FROM named WHERE brand_std <> '' AND model_std <> '' AND model_no_std <> ''
  GROUP BY category, brand_std, model_std, model_no_std)
"""


@query("products", canon("listing") + PRODUCTS + """
SELECT product_id AS id, category, brand_std AS brand_name, model_std AS model_name, model_no_std AS model_no
FROM prod""", "listing", "dictionary")
def products_(i):
    return products.new_products(products.keyed_items(products.unlinked(i.listing), dictionary_of(i)))


@query("product_link", canon("listing") + PRODUCTS + """
SELECT id, prod.product_id FROM named JOIN prod USING (category, brand_std, model_std, model_no_std)""",
       "listing", "dictionary")
def product_link(i):
    return products.aggregate_items(i.listing, dictionary_of(i))[1]


@query("product_stats", canon("listing") + """
SELECT count(*) AS processed, count(*) FILTER (brand_std <> '' AND model_std <> '' AND model_no_std <> '') AS success,
  CAST(0 AS BIGINT) AS failed, count(*) FILTER (NOT (brand_std <> '' AND model_std <> '' AND model_no_std <> ''))
  AS skipped FROM named""", "listing", "dictionary")
def product_stats(i):
    return products.product_stats(i.listing, dictionary_of(i))


# ---- translations -------------------------------------------------------------------------

def _flat_translations(rows, *keys):
    t = F.col("translations")
    return rows.select(*keys, t["en"].alias("en"), t["zh"].alias("zh"), t["ja"].alias("ja"),
                       F.array_join(t["en_variants"], "|").alias("en_variants"))


@query("build_translations", ", " + TRANSLATIONS + """
SELECT brand_name, model_name, en, zh, ja, en_variants FROM tr""", "dictionary")
def build_translations(i):
    d = dictionary_of(i)
    brands = translate.brand_translations(d).withColumn("model_name", F.lit(""))
    both = brands.unionByName(translate.model_translations(d))
    return _flat_translations(both, "brand_name", "model_name")


@query("translations_upsert", ", " + TRANSLATIONS + """
SELECT brand_name, en, zh, ja, en_variants FROM tr WHERE model_name = ''
UNION ALL SELECT s_name, s_name, NULL, NULL, NULL FROM supplier""", "dictionary")
def translations_upsert(i):
    """Old rows: every brand with stale texts, and every supplier name."""
    new = translate.brand_translations(dictionary_of(i))
    stale = F.struct(F.col("brand_name").alias("en"), F.lit("old").alias("zh"), F.lit("old").alias("ja"),
                     F.lit(None).cast("array<string>").alias("en_variants"))
    kept = F.struct(F.col("s_name").alias("en"), F.lit(None).cast("string").alias("zh"),
                    F.lit(None).cast("string").alias("ja"), F.lit(None).cast("array<string>").alias("en_variants"))
    old = new.select("brand_name", stale.alias("translations")).unionByName(
        i.table("supplier").select(F.col("s_name").alias("brand_name"), kept.alias("translations")))
    return _flat_translations(translate.upsert(old, new, "brand_name"), "brand_name")


def _translated(name: str, lang: str, table: str) -> str:
    return f"""CASE WHEN {name} <> '' AND ({language_of(name)}) <> '{lang}'
      THEN coalesce({table}.{lang}, {name}) ELSE {name} END"""


def _translate_sql(lang: str) -> str:
    return f""", {TRANSLATIONS.strip()},
    moved AS (SELECT n.*, {_translated('brand_std', lang, 'tb')} AS brand_tr, {_translated('model_std', lang, 'tm')} AS model_tr
      FROM named n LEFT JOIN tr tb ON tb.model_name = '' AND tb.brand_name = brand_std
      LEFT JOIN tr tm ON tm.model_name <> '' AND tm.brand_name = brand_std AND tm.model_name = model_std)
    """


JAPANESE = f"""
, kb AS (SELECT brand, min(brand_ord) AS o, arg_min(alias, alias_ord) AS kana FROM dictionary
  WHERE model IS NULL AND alias_ord > 0 AND regexp_matches(alias, '{KANA}') GROUP BY brand),
km AS (SELECT brand, model, min(model_ord) AS o, arg_min(alias, alias_ord) AS kana FROM dictionary
  WHERE model IS NOT NULL AND alias_ord > 0 AND regexp_matches(alias, '{KANA}') GROUP BY brand, model),
kb3 AS (SELECT nk AS k, arg_min(kana, o) AS kana FROM bk JOIN kb USING (brand) GROUP BY nk),
km3 AS (SELECT brand, nk AS k, arg_min(kana, o) AS kana FROM mk JOIN km USING (brand, model) GROUP BY brand, nk)
SELECT id,
  CASE WHEN brand_std <> '' AND ({language_of('brand_std')}) <> 'ja'
    THEN coalesce(kb.kana, kb3.kana, brand_std) ELSE brand_std END AS brand_translated,
  CASE WHEN model_std <> '' AND ({language_of('model_std')}) <> 'ja'
    THEN coalesce(km.kana, km3.kana, model_std) ELSE model_std END AS model_translated
FROM named LEFT JOIN kb ON kb.brand = brand_std LEFT JOIN kb3 ON kb3.k = lower({folded('brand_std')})
LEFT JOIN km ON km.brand = brand_std AND km.model = model_std
LEFT JOIN km3 ON km3.brand = brand_std AND km3.k = lower({folded('model_std')})"""


@query("translate_items", canon("listing") + JAPANESE, "listing", "dictionary")
def translate_items(i):
    """Japanese names; the tables hold no Japanese, so the dictionary's aliases decide."""
    d = dictionary_of(i)

    def without_ja(rows):
        return rows.withColumn("translations", F.col("translations").dropFields("ja").withField(
            "ja", F.lit(None).cast("string")))

    named = names.normalize_items(i.listing, d)
    done = translate.translate_names(named, d, without_ja(translate.brand_translations(d)),
                                     without_ja(translate.model_translations(d)), "ja")
    return done.select("id", "brand_translated", "model_translated")


LISTED = canon("listing") + _translate_sql("zh") + f"""
, shown AS (SELECT *, CASE WHEN ({language_of("(brand_name || ' ' || model_name)")}) <> 'zh' AND brand_tr <> brand_name
    THEN brand_tr END AS brand_name_translated,
  CASE WHEN ({language_of("(brand_name || ' ' || model_name)")}) <> 'zh' AND model_tr <> model_name
    THEN model_tr END AS model_name_translated FROM moved)
"""


def listed(i):
    d = dictionary_of(i)
    return translate.translate_listing(i.listing, d, translate.brand_translations(d),
                                       translate.model_translations(d), "zh")


@query("list_translated", LISTED + "SELECT id, brand_name_translated, model_name_translated FROM shown",
       "listing", "dictionary")
def list_translated(i):
    return listed(i).select("id", "brand_name_translated", "model_name_translated")


@query("search_translated", canon("listing") + _translate_sql("zh") + f"""
SELECT id, CASE WHEN other THEN nullif(brand_tr, '') END AS brand_name_translated,
  CASE WHEN other THEN nullif(model_tr, '') END AS model_name_translated
FROM (SELECT *, brand_name <> '' AND model_name <> ''
        AND ({language_of("(brand_name || ' ' || model_name)")}) <> 'zh' AS other FROM moved) x""", "listing", "dictionary")
def search_translated(i):
    """Search pages show a translation even where it equals the name."""
    d = dictionary_of(i)
    shown = translate.translate_listing(i.listing, d, translate.brand_translations(d), translate.model_translations(d),
                                        "zh", only_if_different=False)
    return shown.select("id", "brand_name_translated", "model_name_translated")


# ---- aliases ------------------------------------------------------------------------------

ALIASES = """
al AS (SELECT category, brand, model, string_agg(alias, '|' ORDER BY alias_ord) AS aliases FROM (
    SELECT *, row_number() OVER (PARTITION BY category, brand, model, lower(trim(alias)) ORDER BY alias_ord) AS rn
    FROM dictionary) x WHERE rn = 1 GROUP BY category, brand, model)
"""


@query("alias_expand", ", " + ALIASES + "SELECT category, brand, coalesce(model, '') AS model, aliases FROM al",
       "dictionary")
def alias_expand(i):
    d = dictionary_of(i)
    brands = names.brand_alias_lists(d).select("category", "brand", F.lit("").alias("model"),
                                               F.array_join("brand_aliases", "|").alias("aliases"))
    return brands.unionByName(names.model_alias_lists(d).select(
        "category", "brand", "model", F.array_join("model_aliases", "|").alias("aliases")))


# ---- titles ---------------------------------------------------------------------------------

def _take(words: str, n: str) -> str:
    return f"array_to_string({words}[1:{n}], ' ')"


TITLES = rf"""
c AS (SELECT id, trim(regexp_replace(split_part(split_part(replace(regexp_replace(title, '【[^】]*】', ' ', 'g'),
      '　', ' '), '腕時計', 1), '時計', 1), ' +', ' ', 'g')) AS clean FROM titles),
w AS (SELECT id, clean, regexp_replace(clean, '( (メンズ|レディース))+$', '') AS line FROM c),
ba AS (SELECT alias, brand, brand_ord, alias_ord, len(string_split(alias, ' ')) AS n, lower({folded('alias')}) AS f
       FROM dictionary WHERE model IS NULL),
hits AS (SELECT w.*, string_split(line, ' ') AS words, alias, n,
    starts_with(line || ' ', alias || ' ') OR starts_with(clean, alias) AS exact, brand_ord, alias_ord
  FROM w JOIN ba ON starts_with(line || ' ', alias || ' ') OR starts_with(clean, alias)
    OR starts_with(lower({folded('clean')}), f)),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY exact DESC, length(alias) DESC, brand_ord, alias_ord)
         AS rn FROM hits),
s1 AS (SELECT w.id, w.clean, w.line, string_split(w.line, ' ') AS words, b.alias IS NOT NULL AS found, coalesce(b.n, 0) AS used,
    CASE WHEN b.alias IS NULL THEN string_split(w.line, ' ')[1] WHEN b.exact THEN b.alias
         ELSE {_take('b.words', 'b.n')} END AS brand_name
  FROM w LEFT JOIN best b ON b.id = w.id AND b.rn = 1),
s2 AS (SELECT s1.*, words[used + 1:] AS rest_words, array_to_string(words[used + 1:], ' ') AS rest,
         (SELECT arg_min(brand, brand_ord) FROM ba WHERE ba.alias = brand_name) AS canonical FROM s1),
ma AS (SELECT alias, brand, model_ord, alias_ord, len(string_split(alias, ' ')) AS n, lower({folded('alias')}) AS f
       FROM dictionary WHERE model IS NOT NULL),
mhits AS (SELECT s2.id, alias, n, model_ord, alias_ord, rest_words,
    starts_with(rest, alias) OR contains(' ' || rest || ' ', ' ' || alias || ' ') AS exact
  FROM s2 JOIN ma ON ma.brand = canonical AND (starts_with(rest, alias)
    OR contains(' ' || rest || ' ', ' ' || alias || ' ') OR contains(lower({folded('rest')}), f))),
mbest AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY exact DESC, length(alias) DESC, model_ord, alias_ord)
          AS rn FROM mhits),
s3 AS (SELECT s2.*, CASE WHEN m.alias IS NULL THEN NULL WHEN m.exact THEN m.alias
         ELSE {_take('m.rest_words', 'm.n')} END AS model_found,
         s2.rest_words[coalesce(m.n, 0) + 1:] AS tail
       FROM s2 LEFT JOIN mbest m ON m.id = s2.id AND m.rn = 1),
s4 AS (SELECT *, list_max([k FOR k IN range(1, len(tail) + 1)
         IF regexp_full_match(tail[k], '[A-Za-z0-9./-]{{3,}}') AND regexp_matches(tail[k], '[0-9]')]) AS spot FROM s3)
SELECT id, clean AS clean_title, brand_name,
  coalesce(model_found, nullif(array_to_string([tail[k] FOR k IN range(1, len(tail) + 1) IF (spot IS NULL OR k <> spot)], ' '), ''))
    AS model_name, tail[spot] AS model_no
FROM s4"""


@query("split_title", ", " + TITLES, "titles", "dictionary")
def split_title(i):
    return titles.split_titles(saved(i.titles), dictionary_of(i)).select(
        "id", "clean_title", "brand_name", "model_name", "model_no")


HEADINGS = {"name": "headings", "match": {"url_regex": "^https?://"}, "parse": {"fields": {
    "title": {"pattern": r"<h1>.*?</h1>", "text": True, "transforms": [{"type": "strip"}, {"type": titles.RULE}]},
    "link": {"pattern": r"<a\s[^>]*>.*?</a>", "attr": "href"}}}}


@query("extract_split_title", f"""
, dictionary AS (SELECT * FROM page_dictionary),
titles AS (SELECT page_id AS id, trim({plain("regexp_extract(html, '(?is)<h1>.*?</h1>')")}) AS title FROM pages), {TITLES}""",
       "page_dictionary")
def extract_split_title(i):
    """The title transform as a rule of a profile, over the pages: its fields become fields of the item."""
    profiles = [parse_profile(HEADINGS)]
    pages = read_pages(i.spark, os.path.join(i.folder, "pages.parquet"))
    items = extract.explode_items(extract.extract_records(pages, profiles))
    named = titles.split_title_fields(items, profiles, AliasDictionary(saved(i.page_dictionary)))
    return extract.item_fields(named, ["title", *titles.NAME_FIELDS]).select(
        F.col("page_id").alias("id"), F.col("title").alias("clean_title"), *titles.NAME_FIELDS)
