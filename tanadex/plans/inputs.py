"""Inputs of the registered queries, derived from the shared test tables.

Each input is one SQL text, valid in Spark and in the checking engine; only hash and
time type names differ and are passed in. Text, not logic of the operators.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dialect:
    sha: str
    time: str
    table: str = "{name}"

    def t(self, name: str) -> str:
        return self.table.format(name=name)


SPARK = Dialect(sha="sha2({0}, 256)", time="TIMESTAMP_NTZ", table="{{{name}}}")
CHECK = Dialect(sha="sha256({0})", time="TIMESTAMP")

# Full-width forms of the characters of brand names.
HALF = "BRANDbrand#0123456789"
FULL = "ＢＲＡＮＤｂｒａｎｄ＃０１２３４５６７８９"


# An id for every order line: order and line number repeat, so lines of one number are counted among themselves.
ID_STEP = 1009
LINE_ID = (f"(l_orderkey * 8 + l_linenumber) * {ID_STEP} + row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
           "ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1")


def crawl_log(d: Dialect) -> str:
    sha = d.sha.format("'image' || CAST(user_id AS STRING)")
    key = f"CASE WHEN user_id % 4 > 0 THEN '{{0}}' || substring({sha}, 1, 2) || '/' || {sha} || '{{1}}' END"
    return f"""
    SELECT event_id AS log_id,
      CASE WHEN user_id % 10 < 6 THEN 'watch' WHEN user_id % 10 = 6 THEN 'bag'
           WHEN user_id % 10 = 7 THEN 'jewelry' WHEN user_id % 10 = 8 THEN 'camera'
           WHEN event_id % 50 = 0 THEN ' ' ELSE 'clothing' END AS category,
      'site' || CAST(user_id % 5 AS STRING) || '.example' AS site,
      CAST(user_id AS STRING) AS item_id, props AS raw_json,
      'Brand#' || CAST((user_id + event_id) % 25 + 1 AS STRING) AS brand_name,
      'Model ' || CAST(user_id % 7 AS STRING) AS model_name,
      'REF-' || CAST(user_id AS STRING) AS model_no,
      CASE user_id % 3 WHEN 0 THEN 'JPY' WHEN 1 THEN 'USD' ELSE 'CNY' END AS currency,
      CAST(CASE WHEN event_type = 'signup' AND event_id % 97 = 0 THEN NULL
                ELSE FLOOR(value / 25) * 25 END AS INT) AS price,
      {key.format('original/', '.jpg')} AS image_original_key,
      {key.format('thumb/300/', '.webp')} AS image_thumb_300_key,
      {key.format('thumb/600/', '.webp')} AS image_thumb_600_key,
      CASE WHEN user_id % 4 > 0 THEN {sha} END AS image_sha256,
      'https://site' || CAST(user_id % 5 AS STRING) || '.example/p/' || CAST(user_id AS STRING)
        || '?e=' || CAST(event_id AS STRING) AS product_url,
      CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
      ts AS crawl_time, CAST(ts AS DATE) AS dt
    FROM {d.t('events')}"""


def listing(d: Dialect) -> str:
    """One item per order line, brand and model spelled in four noisy ways."""
    return f"""
    SELECT o.id,
      CASE WHEN o.id % 11 = 0 THEN 'NoName ' || p_brand WHEN o.id % 5 = 0 THEN p_brand
           WHEN line % 4 = 0 THEN upper(p_brand) WHEN line % 4 = 1 THEN '  ' || lower(p_brand) || ' '
           WHEN line % 4 = 2 THEN replace(p_brand, '#', '・#,')
           ELSE translate(p_brand, '{HALF}', '{FULL}') END AS brand_name,
      CASE WHEN o.id % 13 = 0 THEN p_name || ' x' WHEN line % 4 = 0 THEN upper(p_name)
           WHEN line % 4 = 1 THEN p_name WHEN line % 4 = 2 THEN replace(p_name, ' ', '. ')
           ELSE 'モデル' || p_name END AS model_name,
      CASE WHEN o.id % 17 > 0 THEN 'ab ' || CAST(p_partkey AS STRING) END AS model_no,
      CASE WHEN o.id % 19 > 0 THEN CAST(FLOOR(amount) AS BIGINT) END AS price,
      CASE o.id % 3 WHEN 0 THEN 'JPY' WHEN 1 THEN 'USD' ELSE 'CNY' END AS currency,
      'shop' || CAST(suppkey % 10 AS STRING) || '.example' AS site,
      CASE WHEN o.id % 9 = 0 THEN 'bag' ELSE 'watch' END AS category,
      CASE o.id % 10 WHEN 0 THEN 'sold' WHEN 1 THEN 'removed' ELSE 'active' END AS status,
      first_seen_dt, last_seen_dt, created_at, updated_at,
      CASE WHEN o.id % 4 > 0 THEN 'thumb/300/' || CAST(o.id AS STRING) || '.webp' END AS image_thumb_300_key,
      'https://shop.example/products/' || CAST(o.id AS STRING) AS product_url,
      CAST(NULL AS BIGINT) AS product_id
    FROM (SELECT {LINE_ID} AS id, l_linenumber AS line, l_partkey AS partkey, l_suppkey AS suppkey,
                 l_extendedprice AS amount, CAST(l_shipdate AS DATE) AS first_seen_dt, CAST(l_shipdate AS DATE) AS last_seen_dt,
                 l_shipdate AS created_at, l_shipdate AS updated_at
          FROM {d.t('lineitem')}) o
    JOIN {d.t('part')} ON p_partkey = partkey"""


def dictionary(d: Dialect) -> str:
    """Alias rows for every brand and model of the part table."""
    return f"""
    WITH b AS (SELECT p_brand AS brand, ROW_NUMBER() OVER (ORDER BY p_brand) - 1 AS brand_ord,
                      replace(p_brand, 'Brand#', '') AS num
               FROM (SELECT DISTINCT p_brand FROM {d.t('part')}) x),
         m AS (SELECT p_brand AS brand, p_name AS model,
                      ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_name) - 1 AS model_ord
               FROM (SELECT DISTINCT p_brand, p_name FROM {d.t('part')}) x),
         b_n AS ({" UNION ALL ".join(f"SELECT *, {n} AS n FROM b" for n in range(5))}),
         m_n AS ({" UNION ALL ".join(f"SELECT *, {n} AS n FROM m" for n in range(4))})
    SELECT 'watch' AS category, CAST(brand_ord AS BIGINT) AS brand_ord, brand,
           CAST(NULL AS BIGINT) AS model_ord, CAST(NULL AS STRING) AS model, CAST(n AS BIGINT) AS alias_ord,
           CASE n WHEN 0 THEN brand WHEN 1 THEN 'ブランド' || num WHEN 2 THEN '品牌' || num
                  WHEN 3 THEN 'Br ' || num ELSE upper(brand) END AS alias
    FROM b_n
    UNION ALL
    SELECT 'watch', CAST(brand_ord AS BIGINT), m.brand, CAST(model_ord AS BIGINT), model, CAST(n AS BIGINT),
           CASE n WHEN 0 THEN model WHEN 1 THEN 'モデル' || model WHEN 2 THEN '型号' || model
                  ELSE replace(model, ' ', '-') END
    FROM m_n m JOIN b ON m.brand = b.brand"""


def catalog(d: Dialect) -> str:
    """One item per part, for search."""
    return f"""
    SELECT p_partkey AS id,
      CASE p_partkey % 4 WHEN 1 THEN upper(p_brand)
           WHEN 2 THEN 'ブランド' || replace(p_brand, 'Brand#', '') ELSE p_brand END AS brand_name,
      CASE p_partkey % 3 WHEN 1 THEN '型号' || p_name ELSE p_name END AS model_name,
      'P' || CAST(p_partkey AS STRING) AS model_no,
      CASE WHEN p_partkey % 19 > 0 THEN CAST(FLOOR(p_retailprice) AS BIGINT) END AS price,
      CASE p_partkey % 3 WHEN 0 THEN 'JPY' WHEN 1 THEN 'USD' ELSE 'CNY' END AS currency,
      'shop' || CAST(p_size % 5 AS STRING) || '.example' AS site, 'watch' AS category,
      CASE p_partkey % 10 WHEN 0 THEN 'sold' WHEN 1 THEN 'removed' ELSE 'active' END AS status,
      CASE WHEN p_partkey % 23 > 0 THEN DATE '2024-01-01' + CAST(p_partkey % 365 AS INT) END AS last_seen_dt,
      CASE WHEN p_partkey % 4 > 0 THEN 'thumb/300/' || CAST(p_partkey AS STRING) || '.webp' END
        AS image_thumb_300_key,
      'https://shop.example/products/' || CAST(p_partkey AS STRING) AS product_url,
      CAST(DATE '2024-01-01' + CAST(p_partkey % 300 AS INT) AS {d.time}) AS created_at,
      CAST(DATE '2024-01-01' + CAST(p_partkey % 300 + p_size AS INT) AS {d.time}) AS updated_at
    FROM {d.t('part')}"""


def search_queries(d: Dialect) -> str:
    """All model names, Chinese brand aliases, part numbers of the largest part, and '*'."""
    return f"""
    SELECT CAST(ROW_NUMBER() OVER (ORDER BY query) AS BIGINT) AS query_id, query FROM (
      SELECT DISTINCT p_name AS query FROM {d.t('part')}
      UNION SELECT DISTINCT '品牌' || replace(p_brand, 'Brand#', '') FROM {d.t('part')}
      UNION SELECT 'P' || CAST(MAX(p_partkey) AS STRING) FROM {d.t('part')}
      UNION SELECT '*' FROM {d.t('part')}) q"""


def suggest_prefixes(d: Dialect) -> str:
    """Beginnings of model names, brands and numbers in several spellings, and prefixes that nothing begins with."""
    return f"""
    SELECT DISTINCT prefix FROM (
      SELECT substring(p_name, 1, 3) AS prefix FROM {d.t('part')}
      UNION ALL SELECT upper(substring(p_name, 1, 1)) || substring(p_name, 2, 4) || ' ' FROM {d.t('part')}
      UNION ALL SELECT split_part(p_name, ' ', 1) || ' ' || substring(split_part(p_name, ' ', 2), 1, 1) FROM {d.t('part')}
      UNION ALL SELECT lower(substring(p_brand, 1, 7)) FROM {d.t('part')}
      UNION ALL SELECT 'P' || substring(CAST(p_partkey AS STRING), 1, 2) FROM {d.t('part')}
      UNION ALL SELECT 'p' || substring(CAST(p_partkey AS STRING), 1, 1) FROM {d.t('part')}
      UNION ALL SELECT '品牌' || substring(p_brand, 7, 1) FROM {d.t('part')}
      UNION ALL SELECT 'ブ' UNION ALL SELECT '#' UNION ALL SELECT ' ' UNION ALL SELECT '型号none') q"""


def misspelt_queries(d: Dialect) -> str:
    """Model names with an exchanged pair, a missing or a doubled letter."""
    return f"""
    SELECT CAST(ROW_NUMBER() OVER (ORDER BY query) AS BIGINT) AS query_id, query FROM (
      SELECT DISTINCT substring(p_name, 2, 1) || substring(p_name, 1, 1) || substring(p_name, 3, 60) AS query
        FROM {d.t('part')}
      UNION SELECT DISTINCT substring(p_name, 1, 2) || substring(p_name, 4, 60) FROM {d.t('part')}
      UNION SELECT DISTINCT substring(p_name, 1, 3) || substring(p_name, 3, 60) FROM {d.t('part')}) q"""


def titles(d: Dialect) -> str:
    """Listing titles over the order lines."""
    return f"""
    SELECT o.id,
      CASE WHEN line % 4 = 0 THEN '【中古】' || p_brand || '　' || p_name || ' X' || CAST(p_partkey AS STRING)
                                  || '/9 腕時計 メンズ'
           WHEN line % 4 = 1 THEN 'Br ' || replace(p_brand, 'Brand#', '') || ' モデル' || p_name || ' AB-'
                                  || CAST(p_partkey AS STRING) || ' ブルー メンズ'
           WHEN line % 4 = 2 THEN replace(p_brand, '#', '.#') || ' ' || replace(p_name, ' ', '. ') || ' Z'
                                  || CAST(p_partkey AS STRING)
           ELSE 'Unknown ' || p_name || ' ' || CAST(p_partkey AS STRING) || 'Q レディース' END AS title
    FROM (SELECT {LINE_ID} AS id, l_linenumber AS line, l_partkey AS partkey FROM {d.t('lineitem')}) o
    JOIN {d.t('part')} ON p_partkey = partkey"""


HEADING = "replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&')"


def page_dictionary(d: Dialect) -> str:
    """Brands and models named by page headings: the first word or two a brand, the next one or two a model."""
    words = ", ".join(f"split_part({HEADING}, ' ', {k}) AS w{k}" for k in range(1, 5))
    return f"""
    WITH h AS (SELECT page_id, {words} FROM {d.t('pages')}),
         b AS (SELECT w1 AS brand, w2 AS second, MIN(page_id) AS seen FROM h WHERE w1 <> '' GROUP BY w1, w2),
         m AS (SELECT w1 AS brand, w3 AS model, w4 AS fourth, MIN(page_id) AS seen FROM h WHERE w1 <> '' AND w3 <> '' GROUP BY w1, w3, w4)
    SELECT 'watch' AS category, MIN(seen) AS brand_ord, brand, CAST(NULL AS BIGINT) AS model_ord, CAST(NULL AS STRING) AS model,
           CAST(0 AS BIGINT) AS alias_ord, brand AS alias FROM b GROUP BY brand
    UNION ALL SELECT 'watch', MIN(seen) OVER (PARTITION BY brand), brand, NULL, NULL, seen + 1, brand || ' ' || second FROM b WHERE second <> ''
    UNION ALL SELECT 'watch', MIN(seen), brand, MIN(seen), model, CAST(0 AS BIGINT), model FROM m GROUP BY brand, model
    UNION ALL SELECT 'watch', seen, brand, MIN(seen) OVER (PARTITION BY brand, model), model, seen + 1, model || ' ' || upper(fourth)
    FROM m WHERE fourth <> ''"""


def price_texts(d: Dialect) -> str:
    """Prices written in different ways."""
    n = "CAST(CAST(FLOOR(p_retailprice) AS BIGINT) AS STRING)"
    return f"""
    SELECT p_partkey AS id,
      CASE p_partkey % 6 WHEN 0 THEN '1,' || lpad({n}, 3, '0') WHEN 1 THEN ' ' || {n} || ' '
           WHEN 2 THEN {n} || '.75' WHEN 3 THEN '-' || {n} WHEN 4 THEN '¥' || {n} ELSE 'ask ' || p_name END AS txt
    FROM {d.t('part')}"""


INPUTS = {f.__name__: f for f in (crawl_log, listing, dictionary, catalog, search_queries,
                                  misspelt_queries, titles, price_texts, page_dictionary, suggest_prefixes)}
TABLES = {"crawl_log": ("events",), "listing": ("lineitem", "part"), "dictionary": ("part",),
          "catalog": ("part",), "search_queries": ("part",), "misspelt_queries": ("part",),
          "titles": ("lineitem", "part"), "price_texts": ("part",), "page_dictionary": ("pages",), "suggest_prefixes": ("part",)}


class Inputs:
    """The inputs as DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in INPUTS:
            raise AttributeError(name)
        return self.spark.sql(INPUTS[name](SPARK), **{t: self.table(t) for t in TABLES[name]})


def check_sql(body: str, *names: str) -> str:
    """A checking query with the named inputs as common table expressions."""
    ctes = ", ".join(f"{n} AS ({INPUTS[n](CHECK)})" for n in names)
    return f"WITH {ctes} {body}" if ctes else body
