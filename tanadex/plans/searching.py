"""Queries of search documents, postings, ranking and suggestions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tanadex.functions import text
from tanadex.model import MAX_PAGE_SIZE
from tanadex.operators import bounded, prefixes, search, segments
from tanadex.operators.scale import dealt, saved
from tanadex.plans.naming import canon, dictionary_of
from tanadex.plans.registry import query
from tanadex.sources.dictionary import AliasDictionary

# ---- checks ---------------------------------------------------------------------------

TOKENS = r"regexp_extract_all(lower({0}), '[\p{{Han}}\p{{Hiragana}}]|[\p{{Katakana}}ー]+|[\p{{Latin}}\p{{N}}]+')"

DOCS = canon("catalog") + """
, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand, model, lower(trim(alias)) ORDER BY alias_ord)
    AS rn FROM dictionary) x WHERE rn = 1),
bl AS (SELECT brand, list(alias ORDER BY alias_ord) AS l FROM once WHERE model IS NULL GROUP BY brand),
ml AS (SELECT brand, model, list(alias ORDER BY alias_ord) AS l FROM once WHERE model IS NOT NULL GROUP BY brand, model),
docs AS (SELECT n.*, coalesce(bl.l, [brand_std]) AS brand_aliases, coalesce(ml.l, [model_std]) AS model_aliases,
    array_to_string(list_concat(list_concat(coalesce(bl.l, [brand_std]), coalesce(ml.l, [model_std])), [model_no]), ' ')
      AS search_text,
    list_concat(list_concat([brand_name, model_name, model_no], coalesce(bl.l, [brand_std])), coalesce(ml.l, [model_std]))
      AS terms
  FROM named n LEFT JOIN bl ON bl.brand = brand_std LEFT JOIN ml ON ml.brand = brand_std AND ml.model = model_std)
"""


def _toks(col: str) -> str:
    return TOKENS.format(col)


POSTINGS = f"""
, ftok AS (SELECT id, 'brand_name' AS field, {_toks('brand_name')} AS t FROM docs
  UNION ALL SELECT id, 'model_name', {_toks('model_name')} FROM docs
  UNION ALL SELECT id, 'search_text', {_toks('search_text')} FROM docs
  UNION ALL SELECT id, 'brand_aliases', flatten([{_toks('a')} FOR a IN brand_aliases]) FROM docs
  UNION ALL SELECT id, 'model_aliases', flatten([{_toks('a')} FOR a IN model_aliases]) FROM docs
  UNION ALL SELECT id, 'model_no', [model_no] FROM docs),
post AS (SELECT field, term, id, count(*) AS tf, any_value(n) AS doc_len
  FROM (SELECT id, field, unnest(t) AS term, CAST(len(t) AS BIGINT) AS n FROM ftok) x GROUP BY field, term, id),
fstat AS (SELECT field, count(*) AS n_docs, avg(len(t)) AS avg_len FROM ftok WHERE len(t) > 0 GROUP BY field),
df AS (SELECT field, term, count(*) AS df FROM post GROUP BY field, term),
boost AS (SELECT * FROM (VALUES ('brand_name', 3.0::DOUBLE), ('brand_aliases', 2.5::DOUBLE), ('model_name', 2.0::DOUBLE),
  ('model_aliases', 1.5::DOUBLE), ('search_text', 1.0::DOUBLE), ('model_no', 1.0::DOUBLE)) v(field, boost))
"""


def _asked(queries: str) -> str:
    return f"""
, qt AS (SELECT query_id, field, term, count(*) AS repeats FROM (
      SELECT query_id, unnest({_toks('query')}) AS term FROM {queries} WHERE trim(query) NOT IN ('', '*')) x
      JOIN boost ON field <> 'model_no' GROUP BY query_id, field, term
    UNION ALL SELECT query_id, 'model_no', query, 1 FROM {queries} WHERE trim(query) NOT IN ('', '*'))
"""


EXACT_TERMS = """
, asked AS (SELECT query_id, field, term AS match, CAST(repeats AS DOUBLE) AS weight FROM qt)
"""


def _swap(form: str, i: str) -> str:
    return (f"substring({form}, 1, {i} - 1) || substring({form}, {i} + 1, 1) || substring({form}, {i}, 1) "
            f"|| substring({form}, {i} + 2, 200)")


# Every pair of terms is compared here; the operator under test compares only candidates.
FUZZY_TERMS = f"""
, t0 AS (SELECT DISTINCT field, term, CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END AS k
         FROM qt),
t1 AS (SELECT field, term, k, i, {_swap('term', 'i')} AS form FROM (
         SELECT *, unnest(range(1, length(term))) AS i FROM t0 WHERE k > 0) x),
t2 AS (SELECT field, term, k, {_swap('form', 'j')} AS form FROM (
         SELECT *, unnest(range(i + 2, length(term))) AS j FROM t1 WHERE k > 1) x),
forms AS (SELECT DISTINCT * FROM (SELECT field, term, term AS form, k AS room, 0 AS spent FROM t0
          UNION ALL SELECT field, term, form, k - 1, 1 FROM t1 UNION ALL SELECT field, term, form, k - 2, 2 FROM t2) x),
close AS (SELECT f.field, f.term, d.term AS match, min(levenshtein(form, d.term) + spent) AS edits
          FROM forms f JOIN df d ON d.field = f.field AND abs(length(form) - length(d.term)) <= room
          WHERE levenshtein(form, d.term) <= room GROUP BY f.field, f.term, d.term),
asked AS (SELECT query_id, field, match, sum(repeats * (1.0::DOUBLE - edits / least(length(term), length(match)))) AS weight
          FROM qt JOIN close USING (field, term) GROUP BY query_id, field, match)
"""

SCORED = """
, fscore AS (SELECT a.query_id, p.id, a.field, sum(a.weight * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2
      / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) AS s
    FROM asked a JOIN post p ON p.field = a.field AND p.term = a.match
    JOIN df ON df.field = a.field AND df.term = a.match JOIN fstat ON fstat.field = a.field
    GROUP BY a.query_id, p.id, a.field),
matched AS (SELECT query_id, id, round(max(s * boost), 6) AS score FROM fscore JOIN boost USING (field)
    GROUP BY query_id, id)
"""


def matching(queries: str, fuzzy: bool) -> str:
    return DOCS + POSTINGS + _asked(queries) + (FUZZY_TERMS if fuzzy else EXACT_TERMS) + SCORED


def _everything(queries: str) -> str:
    return f"""
, hits AS (SELECT m.query_id, query, score, d.* FROM (SELECT * FROM matched
      UNION ALL SELECT query_id, id, 1.0::DOUBLE FROM {queries}, docs WHERE trim(query) IN ('', '*')) m
    JOIN docs d USING (id) JOIN {queries} USING (query_id)),
judged AS (SELECT *, lower(trim(query)) IN (lower(trim(brand_name)), lower(trim(model_name)), lower(trim(model_no)))
      OR list_contains([lower(trim(a)) FOR a IN brand_aliases], lower(trim(query)))
      OR list_contains([lower(trim(a)) FOR a IN model_aliases], lower(trim(query))) AS exact FROM hits),
kept AS (SELECT * FROM (SELECT *, bool_or(exact) OVER (PARTITION BY query_id) AS any_exact FROM judged) x
      WHERE exact OR NOT any_exact)
"""


# ---- documents ------------------------------------------------------------------------

def _built(i):
    """The search documents, for a query that reads them once: they become postings in the tasks that build them."""
    return search.build_documents(dealt(i.catalog, "id"), dictionary_of(i))


def _docs(i):
    """The search documents, stored as the index they are."""
    return saved(_built(i))


def _flat(docs):
    return docs.select("id", "brand_name", "model_name", "model_no", "category", "search_text",
                       F.array_join("brand_aliases", "|").alias("brand_aliases"),
                       F.array_join("model_aliases", "|").alias("model_aliases"),
                       F.array_join("suggest_input", "|").alias("suggest_input"))


FLAT = """id, brand_name, model_name, model_no, category, search_text, array_to_string(brand_aliases, '|') AS brand_aliases,
  array_to_string(model_aliases, '|') AS model_aliases,
  array_to_string([terms[k] FOR k IN range(1, len(terms) + 1) IF list_position(terms, terms[k]) = k], '|') AS suggest_input"""


@query("search_docs", DOCS + f"SELECT {FLAT} FROM docs", "catalog", "dictionary")
def search_docs(i):
    return _flat(search.build_documents(dealt(i.catalog, "id"), dictionary_of(i)))


@query("items_for_index", f"SELECT {', '.join(search.ITEM_COLUMNS)} FROM listing", "listing")
def items_for_index(i):
    return i.listing.select(*search.ITEM_COLUMNS)


@query("index_subset", DOCS + f"""
SELECT {FLAT} FROM docs WHERE brand_name = (SELECT arg_min(p_brand, p_partkey) FROM part)""", "catalog", "dictionary")
def index_subset(i):
    """Documents of the items touched by a change to one brand's aliases, rebuilt."""
    docs = _docs(i)
    ids = search.affected_items(i.catalog, _first_brand(i))
    rebuilt = search.refresh_documents(docs, i.catalog, ids, dictionary_of(i))
    return _flat(rebuilt.join(ids, "id", "left_semi"))


@query("index_incremental", DOCS + f"""
SELECT {FLAT} FROM docs WHERE updated_at > TIMESTAMP '2024-06-01' OR created_at > TIMESTAMP '2024-06-01'""",
       "catalog", "dictionary")
def index_incremental(i):
    since = F.lit("2024-06-01").cast("timestamp_ntz")
    return _flat(search.build_documents(search.changed_items(i.catalog, since), dictionary_of(i)))


@query("index_delete", DOCS + f"SELECT {FLAT} FROM docs WHERE status <> 'sold'", "catalog", "dictionary")
def index_delete(i):
    return _flat(search.delete_documents(_docs(i), i.catalog.where("status = 'sold'")))


def _first_brand(i):
    return i.table("part").agg(F.min_by("p_brand", "p_partkey").alias("brand_name"))


@query("affected_items", """
SELECT id FROM catalog WHERE brand_name = (SELECT arg_min(p_brand, p_partkey) FROM part)
UNION SELECT c.id FROM catalog c JOIN (SELECT arg_max(p_brand, p_partkey) AS b, arg_max(p_name, p_partkey) AS m FROM part) x
  ON brand_name = b AND model_name = m""", "catalog")
def affected_items(i):
    models = i.table("part").agg(F.max_by("p_brand", "p_partkey").alias("brand_name"),
                                 F.max_by("p_name", "p_partkey").alias("model_name"))
    return search.affected_items(i.catalog, _first_brand(i), models)


# A dictionary before its last change: some brand aliases and models unknown, one brand under another name.
OLD = """
old_dictionary AS (
  SELECT category, brand_ord, CASE WHEN brand = 'Brand#11' THEN 'Brand eleven' ELSE brand END AS brand, model_ord, model, alias_ord, alias
  FROM dictionary WHERE NOT (model IS NULL AND alias LIKE '品牌2%') AND NOT (model IS NOT NULL AND model LIKE 'c%' AND alias_ord < 2))
"""
_STEPS = "bk b1 b2 b3 mk m1 m2 m3 branded named once bl ml docs".split()


def _under_old(sql: str) -> str:
    """The same steps under the old dictionary, with names of their own."""
    for name in _STEPS:
        sql = re.sub(rf"\b{name}\b", f"{name}_o", sql)
    return re.sub(r"\bdictionary\b", "old_dictionary", sql)


def _old_dictionary(i):
    return AliasDictionary(saved(i.spark.sql("WITH " + OLD.replace("FROM dictionary", "FROM {d}") + " SELECT * FROM old_dictionary",
                                             d=i.dictionary)))


@query("affected_items_canonical", DOCS + ", " + OLD + _under_old(DOCS) + """
SELECT n.id FROM docs n JOIN docs_o o ON n.id = o.id WHERE n.brand_std <> o.brand_std OR n.model_std <> o.model_std
  OR n.brand_aliases <> o.brand_aliases OR n.model_aliases <> o.model_aliases""", "catalog", "dictionary")
def affected_items_canonical(i):
    return search.affected_by_dictionary(i.catalog, _old_dictionary(i), dictionary_of(i))


@query("index_upsert", DOCS.replace("catalog", "still").replace(", bk AS", ", still AS (SELECT * FROM catalog WHERE status <> 'sold'), bk AS", 1)
       + POSTINGS + "SELECT field, term, id, tf, doc_len FROM post", "catalog", "dictionary")
def index_upsert(i):
    """An index built under the old dictionary, brought up to date by the documents that the new one alters, less the
    sold items: its living postings are those of a full rebuild."""
    old, new = _old_dictionary(i), dictionary_of(i)
    index = segments.SegmentedIndex(i.spark).upsert(search.build_documents(dealt(i.catalog, "id"), old))
    ids = search.affected_by_dictionary(i.catalog, old, new)
    index.upsert(search.build_documents(i.catalog.join(ids, "id", "left_semi"), new))
    index.delete(i.catalog.where("status = 'sold'").select("id"))
    return index.postings().drop("leads")


@query("inspect_brand", DOCS + f"SELECT {FLAT} FROM docs WHERE brand_name = 'Brand#13'", "catalog", "dictionary")
def inspect_brand(i):
    return _flat(search.inspect_brand(_docs(i), "Brand#13"))


@query("inspect_model", DOCS + f"""
, asked AS (SELECT p_name FROM part ORDER BY p_partkey LIMIT 1)
SELECT {FLAT} FROM docs, asked WHERE list_has_any({_toks('model_name')}, {_toks('p_name')})""", "catalog", "dictionary")
def inspect_model(i):
    """All documents that share a model word with the first part."""
    name = i.table("part").orderBy("p_partkey").select("p_name").first()[0]
    return _flat(search.inspect_model(_docs(i), name))


@query("alias_coverage", DOCS + """
SELECT brand_name, count(*) AS n_docs, count(*) FILTER (contains(all_text, 'hot-')) AS n_with,
  count(*) FILTER (NOT contains(all_text, 'hot-')) AS n_without
FROM (SELECT brand_name, lower(brand_name || ' ' || model_name || ' ' || search_text) AS all_text FROM docs) x
GROUP BY brand_name""", "catalog", "dictionary")
def alias_coverage(i):
    return search.alias_coverage(_docs(i), "HOT-")


# ---- tokens and postings -----------------------------------------------------------------

@query("tokenize", f"""
SELECT term, count(*) AS n FROM (SELECT unnest({_toks('text')}) AS term FROM documents) x GROUP BY term""")
def tokenize(i):
    return (i.table("documents").select(F.explode(text.tokens("text")).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("n")))


@query("postings", DOCS + POSTINGS + "SELECT field, term, id, tf, doc_len FROM post", "catalog", "dictionary")
def postings(i):
    return search.postings(search.build_documents(dealt(i.catalog, "id"), dictionary_of(i))).drop("leads")


# ---- matching and ranking ------------------------------------------------------------------

@query("search_match", matching("search_queries", False) + "SELECT query_id, id, score FROM matched",
       "catalog", "dictionary", "search_queries")
def search_match(i):
    return search.match(i.search_queries, _built(i), fuzzy=False)


@query("search_fuzzy", matching("misspelt_queries", True) + "SELECT query_id, id, score FROM matched",
       "catalog", "dictionary", "misspelt_queries")
def search_fuzzy(i):
    return search.match(i.misspelt_queries, _built(i))


@query("search_all", """
SELECT (SELECT query_id FROM search_queries WHERE query = '*') AS query_id, id, 1.0::DOUBLE AS score FROM catalog""",
       "catalog", "search_queries")
def search_all(i):
    return search.match_all(i.search_queries.where("query = '*'"), i.catalog)


@query("search_filters", """
SELECT id, price FROM catalog WHERE status = 'active' AND site = 'shop1.example' AND category = 'watch'
  AND price >= 901 AND price <= 1900 AND currency = 'USD'""", "catalog")
def search_filters(i):
    return search.apply_filters(i.catalog, status="active", site="shop1.example", category="watch", min_price=901,
                                max_price=1900, currency="USD").select("id", "price")


def _hits(i):
    docs = _docs(i)
    found = search.match(i.search_queries, docs, fuzzy=False)
    return found.join(docs.select("id", "price", "last_seen_dt", "created_at"), "id")


def _ranked_sql(order: str, first: int, last: int) -> str:
    return matching("search_queries", False) + f"""
SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY {order}, score DESC, id) AS rank
  FROM matched JOIN catalog USING (id)) x WHERE rank BETWEEN {first} AND {last}"""


@query("search_sorted", _ranked_sql("price DESC NULLS LAST", 1, 100), "catalog", "dictionary", "search_queries")
def search_sorted(i):
    """First page of the largest size, dearest items first."""
    return search.page_of(_hits(i), search.sort_order("price", "desc"), 1, MAX_PAGE_SIZE).select(
        "query_id", "id", "score", "rank")


@query("search_page", _ranked_sql("price ASC NULLS LAST", 11, 20), "catalog", "dictionary", "search_queries")
def search_page(i):
    return search.page_of(_hits(i), search.sort_order("price", "asc"), 2, 10).select("query_id", "id", "score", "rank")


@query("search_recall", _ranked_sql("last_seen_dt DESC NULLS LAST", 1, 100), "catalog", "dictionary", "search_queries")
def search_recall(i):
    return search.ranked(_hits(i), search.sort_order(None), 1, MAX_PAGE_SIZE).select(
        "query_id", "id", "score", "rank")


@query("search_exact_narrow", matching("search_queries", False) + _everything("search_queries") + """
SELECT query_id, id, exact FROM kept""", "catalog", "dictionary", "search_queries")
def search_exact_narrow(i):
    return search.narrowed_hits(saved(i.search_queries), _docs(i), fuzzy=False)


@query("search_ranked", matching("search_queries", True) + _everything("search_queries") + """
SELECT query_id, id, score, CAST(rank AS INT) AS rank, total FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, last_seen_dt DESC NULLS LAST, id) AS rank,
    count(*) OVER (PARTITION BY query_id) AS total FROM kept) x WHERE rank <= 20""",
       "catalog", "dictionary", "search_queries")
def search_ranked(i):
    docs = _docs(i)
    found = bounded.search_ranked(i.search_queries, docs, bounded.build_index(docs))
    return found.select("query_id", "id", "score", "rank", "total")


# ---- suggestions ---------------------------------------------------------------------------

def _hit(col: str) -> str:
    return f"contains(' ' || array_to_string({_toks(col)}, ' '), ' cold w')"


def _scored(col: str) -> str:
    return f"CAST({_hit(col)} AS INT)"


@query("suggest", DOCS + f"""
, m AS (SELECT *, {_scored('brand_name')} + {_scored('model_name')} + {_scored('search_text')}
      + CAST(len([a FOR a IN brand_aliases IF {_hit('a')}]) > 0 AS INT)
      + CAST(len([a FOR a IN model_aliases IF {_hit('a')}]) > 0 AS INT)
      + CAST(starts_with(model_no, 'Cold w') AS INT) AS score FROM docs),
best AS (SELECT * FROM m WHERE score > 0),
t AS (SELECT score, id, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM best),
f AS (SELECT term, min((-score, id, pos)) AS first FROM t WHERE starts_with(lower(term), 'cold w') GROUP BY term)
SELECT term, CAST(row_number() OVER (ORDER BY first) AS INT) AS place FROM f ORDER BY first LIMIT 5""",
       "catalog", "dictionary")
def suggest(i):
    return search.suggest(_docs(i), "Cold w")


def _points(line: str) -> str:
    return f"CAST(contains({line}, asked) AS INT)"


@query("suggest_batch", DOCS + f"""
, lines AS (SELECT *, ' ' || array_to_string({_toks('brand_name')}, ' ') AS l1, ' ' || array_to_string({_toks('model_name')}, ' ') AS l2,
    ' ' || array_to_string({_toks('search_text')}, ' ') AS l3,
    [' ' || array_to_string({_toks('a')}, ' ') FOR a IN brand_aliases] AS l4,
    [' ' || array_to_string({_toks('a')}, ' ') FOR a IN model_aliases] AS l5 FROM docs),
q AS (SELECT prefix, trim(prefix) AS p, ' ' || array_to_string({_toks('prefix')}, ' ') AS asked FROM suggest_prefixes
      WHERE trim(prefix) <> ''),
m AS (SELECT q.*, id, terms, CASE WHEN asked = ' ' THEN 0 ELSE {_points('l1')} + {_points('l2')} + {_points('l3')}
      + CAST(len([a FOR a IN l4 IF contains(a, asked)]) > 0 AS INT) + CAST(len([a FOR a IN l5 IF contains(a, asked)]) > 0 AS INT) END
      + CAST(starts_with(model_no, p) AS INT) AS score FROM q, lines),
t AS (SELECT prefix, p, score, id, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM m WHERE score > 0),
f AS (SELECT prefix, term, min((-score, id, pos)) AS first FROM t WHERE starts_with(lower(term), lower(p)) GROUP BY prefix, term)
SELECT prefix, CAST(place AS INT) AS place, term FROM (
  SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY first) AS place FROM f) x WHERE place <= 5""",
       "catalog", "dictionary", "suggest_prefixes")
def suggest_batch(i):
    """Answers for a table of prefixes from an index of two parts, by status, that were indexed apart and merged."""
    docs = _docs(i)
    parts = [prefixes.stored_index(docs.where(fit)) for fit in (F.col("status") == "active", F.col("status") != "active")]
    return prefixes.suggest_batch(saved(prefixes.merge_indexes(parts)), i.suggest_prefixes)
