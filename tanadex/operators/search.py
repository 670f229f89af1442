"""Search documents, postings, ranked matching for many queries at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanadex.functions.text import lower_key, match_key, strip, term_counts, tokens
from tanadex.model import search_arguments
from tanadex.operators.names import (brand_alias_lists, canonical_brand, canonical_model,
                                     model_alias_lists)
from tanadex.operators.scale import saved
from tanadex.sources.dictionary import TIERS, AliasDictionary

# Fields searched and their weights; model_no counts as one whole term.
BOOSTS = {
    "brand_name": 3.0,
    "brand_aliases": 2.5,
    "model_name": 2.0,
    "model_aliases": 1.5,
    "search_text": 1.0,
    "model_no": 1.0,
}
TEXT_FIELDS = tuple(f for f in BOOSTS if f != "model_no")
# Usual BM25 parameters.
K1, B = 1.2, 0.75
# Allowed edits by length of the query term: up to 2, 3 to 5, longer.
SHORT_TERM, MEDIUM_TERM = 2, 5
SCORE_DIGITS = 6
# Postings whose documents are scored in one task.
TASK_POSTINGS = 1 << 18

ITEM_COLUMNS = ("id", "brand_name", "model_name", "model_no", "price", "currency", "site", "category",
                "status", "last_seen_dt", "image_thumb_300_key", "product_url", "created_at")


# ---- documents -------------------------------------------------------------------

def build_documents(items: DataFrame, dictionary: AliasDictionary,
                    force_category: str | None = None) -> DataFrame:
    """Search documents: names as stored, aliases found through the canonical names."""
    rows = items.select(*ITEM_COLUMNS)
    if force_category:
        rows = rows.withColumn("category", F.lit(force_category))
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("brand_name", "model_name", "model_no")})
    named = canonical_model(canonical_brand(rows, dictionary), dictionary)
    joined = (named
              .join(dictionary.small("brand_alias_lists", lambda: brand_alias_lists(dictionary)
                                     .withColumnsRenamed({"brand": "brand_std", "brand_aliases": "b_list"})),
                    ["category", "brand_std"], "left")
              .join(dictionary.small("model_alias_lists", lambda: model_alias_lists(dictionary)
                                     .withColumnsRenamed({"brand": "brand_std", "model": "model_std",
                                                          "model_aliases": "m_list"})),
                    ["category", "brand_std", "model_std"], "left"))
    none = F.array().cast("array<string>")

    def listed(found, raw, standard):
        return F.when(F.col(raw) == "", none).otherwise(F.coalesce(found, F.array(standard)))

    docs = joined.withColumns({"brand_aliases": listed("b_list", "brand_name", "brand_std"),
                               "model_aliases": listed("m_list", "model_name", "model_std")})
    filled = F.filter(F.array("model_no"), lambda x: x != "")
    names = F.filter(F.array("brand_name", "model_name"), lambda x: x != "")
    return docs.select(
        *ITEM_COLUMNS, "brand_aliases", "model_aliases",
        F.array_join(F.concat("brand_aliases", "model_aliases", filled), " ").alias("search_text"),
        F.array_distinct(F.concat(names, filled, "brand_aliases", "model_aliases")).alias("suggest_input"))


def upsert_documents(index: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.unionByName(index.join(docs.select("id"), "id", "left_anti"))


def delete_documents(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id"), "id", "left_anti")


def changed_items(items: DataFrame, since=None) -> DataFrame:
    """Items updated or created after a time; all of them without one."""
    if since is None:
        return items
    since = F.lit(since) if isinstance(since, str) else since
    return items.where((F.col("updated_at") > since) | (F.col("created_at") > since))


def affected_items(items: DataFrame, brands: DataFrame | None = None, models: DataFrame | None = None,
                   dictionary: AliasDictionary | None = None) -> DataFrame:
    """Ids of items of the given brands, or of the given (brand_name, model_name) pairs.

    Stored spellings are compared; with a dictionary, canonical names are, so that
    items stored under an alias are found as well.
    """
    rows, brand, model = items, "brand_name", "model_name"
    if dictionary is not None:
        rows, brand, model = canonical_model(canonical_brand(items, dictionary), dictionary), "brand_std", "model_std"
    keyed = rows.select("id", F.col(brand).alias("brand_name"), F.col(model).alias("model_name"))
    parts = []
    if brands is not None:
        parts.append(keyed.join(brands.select("brand_name"), "brand_name", "left_semi"))
    if models is not None:
        parts.append(keyed.join(models.select("brand_name", "model_name"),
                                ["brand_name", "model_name"], "left_semi"))
    return reduce(DataFrame.unionByName, [p.select("id") for p in parts]).distinct()


def _alias_view(names: DataFrame, dictionary: AliasDictionary) -> DataFrame:
    """``names`` (category, brand_name, model_name) with all that a document takes from the dictionary, as ``view``."""
    named = canonical_model(canonical_brand(names, dictionary), dictionary)
    lists = (named.join(brand_alias_lists(dictionary).withColumnsRenamed({"brand": "brand_std", "brand_aliases": "b_list"}),
                        ["category", "brand_std"], "left")
             .join(model_alias_lists(dictionary).withColumnsRenamed({"brand": "brand_std", "model": "model_std", "model_aliases": "m_list"}),
                   ["category", "brand_std", "model_std"], "left"))
    return lists.select(*names.columns, F.struct("brand_std", "model_std", "b_list", "m_list").alias("view"))


def dictionary_changes(old: AliasDictionary, new: AliasDictionary) -> dict[str, DataFrame]:
    """What differs between two dictionaries: (kind, brand, key) of lookups that give another name, and names whose alias
    lists differ. Only rows of the dictionaries are compared."""
    def differ(before, after, keys, value):
        both = before.withColumnRenamed(value, "was").join(after.withColumnRenamed(value, "now"), keys, "full_outer")
        return both.where(~F.col("was").eqNullSafe(F.col("now"))).select(*keys)
    brands = [differ(old.brand_lookup(t), new.brand_lookup(t), ["category", f"key_{t}"], f"brand_{t}")
              .withColumnRenamed(f"key_{t}", "key").withColumn("tier", F.lit(t)) for t in TIERS]
    models = [differ(old.model_lookup(t), new.model_lookup(t), ["category", "lookup_brand", f"key_{t}"], f"model_{t}")
              .withColumnRenamed(f"key_{t}", "key").withColumn("tier", F.lit(t)) for t in TIERS]
    return {
        "brand_keys": reduce(DataFrame.unionByName, brands), "model_keys": reduce(DataFrame.unionByName, models),
        "brand_lists": differ(brand_alias_lists(old), brand_alias_lists(new), ["category", "brand"], "brand_aliases"),
        "model_lists": differ(model_alias_lists(old), model_alias_lists(new), ["category", "brand", "model"], "model_aliases")}


def affected_by_dictionary(items: DataFrame, old: AliasDictionary, new: AliasDictionary) -> DataFrame:
    """Ids of items whose documents the change from one dictionary to the other alters.

    The difference of the dictionaries is carried to the distinct names that can meet it: names under a changed lookup
    key, and names whose canonical form has a changed alias list. Only these are named by both dictionaries and
    compared; a name whose changed key is not the one that decides stays out.
    """
    change = dictionary_changes(old, new)
    blank = {c: F.coalesce(c, F.lit("")) for c in ("brand_name", "model_name")}
    rows = items.select("id", "category", *[v.alias(c) for c, v in blank.items()])
    names = rows.select("category", "brand_name", "model_name").distinct()

    def keyed(name):
        tiers = F.array(*[F.struct(F.lit(t).alias("tier"), key.alias("key")) for t, key in
                          (("exact", strip(name)), ("lower", lower_key(name)), ("folded", match_key(name)))])
        return F.inline(tiers)
    triple = ["category", "brand_name", "model_name"]
    known = canonical_model(canonical_brand(names, new), new).select(*triple, "brand_std", "model_std")
    met = [names.select(*triple, keyed("brand_name")).join(change["brand_keys"], ["category", "tier", "key"], "left_semi"),
           known.select(*triple, F.col("brand_std").alias("lookup_brand"), keyed("model_name"))
           .join(change["model_keys"], ["category", "lookup_brand", "tier", "key"], "left_semi"),
           known.withColumnRenamed("brand_std", "brand").join(change["brand_lists"], ["category", "brand"], "left_semi"),
           known.withColumnsRenamed({"brand_std": "brand", "model_std": "model"})
           .join(change["model_lists"], ["category", "brand", "model"], "left_semi")]
    candidates = reduce(DataFrame.unionByName, [m.select(*triple) for m in met]).distinct()
    before, after = (_alias_view(candidates, d).withColumnRenamed("view", v) for d, v in ((old, "was"), (new, "now")))
    changed = before.join(after, triple).where(~F.col("was").eqNullSafe(F.col("now"))).select(*triple)
    return rows.join(changed, triple, "left_semi").select("id")


def refresh_documents(index: DataFrame, items: DataFrame, ids: DataFrame,
                      dictionary: AliasDictionary) -> DataFrame:
    """Rebuild the documents of the given items and put them into the index."""
    docs = build_documents(items.join(ids.select("id"), "id", "left_semi"), dictionary)
    return upsert_documents(index, docs)


def inspect_brand(index: DataFrame, brand: str) -> DataFrame:
    return index.where(F.col("brand_name") == brand)


def inspect_model(index: DataFrame, model: str) -> DataFrame:
    """All documents whose model name shares a token with the given one."""
    return index.where(F.arrays_overlap(tokens("model_name"), tokens(F.lit(model))))


def alias_coverage(index: DataFrame, term: str) -> DataFrame:
    """Per brand: documents whose text contains the term, and those without it."""
    text = F.lower(F.concat_ws(" ", "brand_name", "model_name", F.array_join("brand_aliases", " "),
                               F.array_join("model_aliases", " "), "search_text"))
    has = F.instr(text, term.lower()) > 0
    return (index.groupBy("brand_name").agg(F.count(F.lit(1)).alias("n_docs"),
                                            F.count_if(has).alias("n_with"),
                                            F.count_if(~has).alias("n_without")))


# ---- postings --------------------------------------------------------------------

def _field_tokens(field: str) -> Column:
    if field.endswith("_aliases"):
        return F.flatten(F.transform(field, tokens))
    if field == "model_no":
        return F.filter(F.array(field), lambda x: x.isNotNull() & (x != ""))
    return tokens(field)


def postings(docs: DataFrame) -> DataFrame:
    """field, term, id, tf, field length, and whether it is the field's leading row.

    Terms are counted inside each row, so building postings takes no shuffle.
    """
    per_field = docs.select("id", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), _field_tokens(f).alias("toks")) for f in BOOSTS])).alias("f"))
    counted = per_field.select("id", "f.field", F.size("f.toks").cast("bigint").alias("doc_len"),
                               term_counts(F.col("f.toks")).alias("terms"))
    return (counted.select("id", "field", "doc_len", F.posexplode("terms").alias("n", "t"))
            .select("field", F.col("t.term").alias("term"), "id", F.col("t.tf").alias("tf"), "doc_len",
                    (F.col("n") == 0).alias("leads")))


def field_stats(index: DataFrame) -> DataFrame:
    """Documents with a non-empty field and its mean length, per field."""
    return (index.where("leads").groupBy("field")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len")))


def vocabulary(index: DataFrame) -> DataFrame:
    """Document frequency of each term per field."""
    return index.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


# ---- query terms -----------------------------------------------------------------

def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, field, term, repeats: tokens for text fields, the whole query for model_no."""
    words = (queries.select("query_id", F.explode(term_counts(tokens("query"))).alias("t"))
             .select("query_id", F.explode(F.array(*[F.lit(f) for f in TEXT_FIELDS])).alias("field"),
                     F.col("t.term").alias("term"), F.col("t.tf").alias("repeats")))
    whole = queries.select("query_id", F.lit("model_no").alias("field"), F.col("query").alias("term"),
                           F.lit(1).cast("bigint").alias("repeats"))
    return words.unionByName(whole)


def allowed_edits(term) -> Column:
    n = F.length(term)
    return F.when(n <= SHORT_TERM, 0).when(n <= MEDIUM_TERM, 1).otherwise(2)


def _swapped(term: Column, i: Column) -> Column:
    """The term with its characters i and i+1 exchanged (counted from 1)."""
    return F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, F.lit(1)),
                    F.substring(term, i, F.lit(1)), F.substring(term, i + 2, F.length(term)))


def _variants(term: Column, edits: Column) -> Column:
    """The term itself, with one and with two separate neighbour exchanges.

    Each exchange costs one edit, so every variant carries the edits left.
    """
    n = F.length(term)
    none = F.array().cast("array<int>")
    spots = F.when((edits > 0) & (n > 1), F.sequence(F.lit(1), n - 1)).otherwise(none)
    once = F.transform(spots, lambda i: F.struct(_swapped(term, i).alias("form"), (edits - 1).alias("left"),
                                                 F.lit(1).alias("spent")))
    later = F.transform(spots, lambda i: F.transform(
        F.filter(spots, lambda j: (edits > 1) & (j >= i + 2)),
        lambda j: F.struct(_swapped(_swapped(term, i), j).alias("form"), (edits - 2).alias("left"),
                           F.lit(2).alias("spent"))))
    itself = F.array(F.struct(term.alias("form"), edits.alias("left"), F.lit(0).alias("spent")))
    return F.concat(itself, once, F.flatten(later))


def _piece_bounds(length: Column, pieces: Column) -> Column:
    """Start (from 1) and size of each of ``pieces`` even parts of a string."""
    return F.transform(F.sequence(F.lit(0), pieces - 1), lambda p: F.struct(
        p.alias("p"), (F.floor(p * length / pieces) + 1).cast("int").alias("at"),
        (F.floor((p + 1) * length / pieces) - F.floor(p * length / pieces)).cast("int").alias("n")))


def fuzzy_terms(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Vocabulary terms within the allowed edits of each query term: term, match, edits.

    Of k+1 even pieces of a vocabulary term, k edits leave one untouched, and it
    occurs in the query term at most k places away. Terms therefore meet by equality
    on (edits, length, piece, text), and only those pairs are compared. An exchange of
    neighbours counts as one edit. The pieces of the query terms are stored, so that their
    size is known: few queries are broadcast, and the vocabulary's pieces stay where they are.
    """
    wanted = terms.select("field", "term").distinct().withColumn("edits", allowed_edits("term"))
    known = vocab.select("field", F.col("term").alias("match"))
    budgets = F.array(*[F.lit(k) for k in (0, 1, 2)])
    indexed = (known.withColumn("n", F.length("match"))
               .withColumn("left", F.explode(budgets)).where(F.col("n") > F.col("left"))
               .withColumn("piece", F.explode(_piece_bounds(F.col("n"), F.col("left") + 1)))
               .select("field", "match", "left", "n", F.col("piece.p").alias("p"),
                       F.substring(F.col("match"), F.col("piece.at"), F.col("piece.n")).alias("text")))
    forms = (wanted.withColumn("v", F.explode(_variants(F.col("term"), F.col("edits"))))
             .select("field", "term", "v.form", "v.left", "v.spent"))
    probes = saved(forms.withColumn("n", F.explode(F.sequence(
                  F.greatest(F.length("form") - F.col("left"), F.col("left") + 1),
                  F.greatest(F.length("form") + F.col("left"), F.col("left") + 1))))
              .withColumn("piece", F.explode(_piece_bounds(F.col("n"), F.col("left") + 1)))
              .withColumn("shift", F.explode(F.sequence(-F.col("left"), F.col("left"))))
              .withColumn("from", F.col("piece.at") + F.col("shift"))
              .where((F.col("from") >= 1)
                     & (F.col("from") + F.col("piece.n") - 1 <= F.length("form")))
              .select("field", "term", "form", "left", "spent", "n", F.col("piece.p").alias("p"),
                      F.substring(F.col("form"), F.col("from"), F.col("piece.n")).alias("text"))
              .distinct())
    pairs = (indexed.join(probes, ["field", "left", "n", "p", "text"])
             .select("field", "term", "match", "form", "left", "spent").distinct())
    distance = F.expr("levenshtein(form, match, left)")
    close = (pairs.withColumn("d", distance).where(F.col("d") >= 0)
             .groupBy("field", "term", "match")
             .agg(F.min(F.col("d") + F.col("spent")).cast("bigint").alias("edits")))
    return close


def _expanded(terms: DataFrame, index: DataFrame, fuzzy: bool) -> DataFrame:
    """Query terms with the index terms that stand for them and their weight."""
    if not fuzzy:
        return terms.select("*", F.col("term").alias("match"), F.lit(1.0).alias("weight"))
    close = fuzzy_terms(terms, index.select("field", "term").distinct())
    shorter = F.least(F.length("term"), F.length("match"))
    return terms.join(close, ["field", "term"]).select(
        "query_id", "field", "term", "repeats", "match",
        (1.0 - F.col("edits") / shorter).alias("weight"))


# ---- matching and ranking --------------------------------------------------------

def is_match_all(query) -> Column:
    """Blank queries and a lone asterisk match every document."""
    text = strip(F.coalesce(query, F.lit("")))
    return (text == "") | (text == "*")


def match(queries: DataFrame, docs: DataFrame, fuzzy: bool = True,
          index: DataFrame | None = None) -> DataFrame:
    """query_id, id, score: any term in any field; the best field's weighted BM25 sum.

    ``queries`` has query_id and query; ``index`` holds stored postings. Postings are filtered by a hash lookup of the
    query terms. What is left is dealt by document, as many postings to a task at any size, and meets the weighted terms
    there; the hits themselves, which are many more, are summed where they arise.
    """
    index = saved(postings(docs)) if index is None else index
    asked = _expanded(query_terms(queries.where(~is_match_all(F.col("query")))), index, fuzzy)
    asked = saved(asked.groupBy("query_id", "field", "match")
                  .agg(F.sum(F.col("repeats") * F.col("weight")).alias("weight")))
    wanted = asked.select("field", F.col("match").alias("term")).distinct()
    hits = index.join(wanted, ["field", "term"], "left_semi")
    stats = (vocabulary(hits).join(F.broadcast(field_stats(index)), "field")
             .withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
             .select("field", F.col("term").alias("match"), "idf", "avg_len"))
    weighted = saved(asked.join(stats, ["field", "match"]))  # one row per asked term
    scored = (hits.withColumnRenamed("term", "match").repartition(index.count() // TASK_POSTINGS + 1, "id")
              .join(weighted, ["field", "match"])
              .withColumn("s", F.col("weight") * F.col("idf") * F.col("tf") * (K1 + 1)
                          / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))))
    per_field = [F.coalesce(F.sum(F.when(F.col("field") == f, F.col("s"))), F.lit(0.0)) * boost
                 for f, boost in BOOSTS.items()]
    return (scored.groupBy("query_id", "id")
            .agg(F.round(F.greatest(*per_field), SCORE_DIGITS).alias("score")))


def match_all(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Every document with score 1.0, for each query that asks for all.

    The ids of those queries are stored, so that their size is known and few of them go to the documents.
    """
    every = saved(queries.where(is_match_all(F.col("query"))).select("query_id"))
    return docs.select("id").crossJoin(every).select("query_id", "id", F.lit(1.0).alias("score"))


def apply_filters(docs: DataFrame, status=None, site=None, category=None, brand_name=None,
                  min_price=None, max_price=None, currency=None) -> DataFrame:
    """All given conditions hold; brand is the stored spelling; a missing price fails a range."""
    ok = search_arguments(status=status, category=category, currency=currency)
    rows = docs
    for name, value in (("status", ok["status"]), ("site", site), ("category", ok["category"]),
                        ("brand_name", brand_name), ("currency", ok["currency"])):
        if value:
            rows = rows.where(F.col(name) == value)
    if min_price is not None:
        rows = rows.where(F.col("price") >= min_price)
    if max_price is not None:
        rows = rows.where(F.col("price") <= max_price)
    return rows


def sort_order(field: str | None, order: str | None = "desc", default: str = "last_seen_dt") -> list[Column]:
    """Sort columns: missing values last both ways, then score, then id."""
    score = F.col("score").desc_nulls_last()
    if field is None:
        field, order = default, "desc"
    if field not in ("price", "last_seen_dt", "created_at"):
        return [score, F.col("id")]
    column = F.col(field).asc_nulls_last() if order == "asc" else F.col(field).desc_nulls_last()
    return [column, score, F.col("id")]


def ranked(hits: DataFrame, order: list[Column], first: int, last: int) -> DataFrame:
    """Rows ranked ``first`` to ``last`` of each query.

    The rank limit is applied before the shuffle as well, so a query that matches a
    large part of the index sends at most ``last`` rows per task.
    """
    place = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return hits.withColumn("rank", place).where(F.col("rank") <= last).where(F.col("rank") >= first)


def page_of(hits: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    return ranked(hits, order, (page - 1) * page_size + 1, page * page_size)


def is_exact(query: Column) -> Column:
    """The query equals a name, the number or an alias of the document, case ignored."""
    wanted = lower_key(query)
    same = F.lit(False)
    for c in ("brand_name", "model_name", "model_no"):
        same = same | F.coalesce(lower_key(c) == wanted, F.lit(False))
    has_brand = F.coalesce(F.col("brand_name"), F.lit("")) != ""
    has_model = F.coalesce(F.col("model_name"), F.lit("")) != ""
    same = same | (has_brand & F.exists("brand_aliases", lambda a: lower_key(a) == wanted))
    same = same | (has_brand & has_model & F.exists("model_aliases", lambda a: lower_key(a) == wanted))
    return same & (wanted != "")


def narrow(hits: DataFrame) -> DataFrame:
    """With exact matches among a query's hits, keep only those.

    One flag per query is aggregated and joined back, so the hits of one query are
    never gathered in one task.
    """
    any_exact = (hits.groupBy("query_id").agg(F.max("exact").alias("any_exact"))
                 .where("any_exact").select("query_id", "any_exact"))
    flagged = hits.join(any_exact, "query_id", "left")
    return flagged.where(F.col("exact") | F.col("any_exact").isNull()).drop("any_exact")


def key_pairs(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, id, query, model_no): documents that ``is_exact`` finds for a query, by equality of keys."""
    has_brand = F.coalesce("brand_name", F.lit("")) != ""
    has_model = F.coalesce("model_name", F.lit("")) != ""
    none = F.array().cast("array<string>")
    keys = F.transform(F.concat(F.array("brand_name", "model_name", "model_no"), F.when(has_brand, F.col("brand_aliases")).otherwise(none),
                                F.when(has_brand & has_model, F.col("model_aliases")).otherwise(none)), lower_key)
    named = docs.select("id", "model_no", F.explode(F.array_distinct(keys)).alias("key")).where(F.col("key") != "")
    asked = queries.select("query_id", "query", lower_key("query").alias("key"))
    return named.join(asked, "key").select("query_id", "id", "query", "model_no")


def exact_pairs(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, id): exact documents among a query's hits.

    Such a document matches the query if that has words at all, or if it is the number as written.
    """
    return (key_pairs(queries, docs).where((F.size(tokens("query")) > 0) | (F.col("model_no") == F.col("query")))
            .select("query_id", "id"))


def narrowed_hits(queries: DataFrame, docs: DataFrame, fuzzy: bool = True, index: DataFrame | None = None) -> DataFrame:
    """query_id, id, exact: the hits of every query, of which only the exact ones stay where there are any.

    The same rows as ``narrow`` over ``match`` and ``match_all``. Exact hits are found by equality of keys, and only
    queries without any are matched by their words.
    """
    asks_all = is_match_all(F.col("query"))
    pairs = saved(exact_pairs(queries.where(~asks_all), docs)
                  .unionByName(key_pairs(queries.where(asks_all), docs).select("query_id", "id")))
    narrowed = saved(pairs.select("query_id").distinct())
    left = saved(queries.join(narrowed, "query_id", "left_anti"))
    rest = match_all(left, docs).select("query_id", "id")
    if not left.where(~asks_all).isEmpty():
        rest = rest.unionByName(match(left, docs, fuzzy, index).select("query_id", "id"))
    return pairs.withColumn("exact", F.lit(True)).unionByName(rest.withColumn("exact", F.lit(False)))


def search(queries: DataFrame, docs: DataFrame, page: int = 1, page_size: int = 20,
           sort_field: str | None = None, order: str = "desc", fuzzy: bool = True,
           recall: int | None = None, filters: dict | None = None,
           rerank: Callable[[DataFrame], DataFrame] | None = None,
           index: DataFrame | None = None) -> DataFrame:
    """Recall, narrow to exact matches, sort, rerank, page; many queries in one job.

    Every match is considered, so an exact one is found whenever it was last seen, and
    only the page bounds the answer. A given ``recall`` takes that many hits before
    narrowing: by the sort field, or by last seen date; the result is then by score.
    """
    alike = _asked_alike(queries)
    once = queries.join(alike, "query_id", "left_semi")
    matched = match(queries, docs, fuzzy, index).unionByName(match_all(once, docs))
    chosen = apply_filters(docs, **(filters or {}))
    wide = chosen.select("id", "price", "last_seen_dt", "created_at")
    hits = matched.join(wide, "id")
    if recall is not None:
        hits = ranked(hits, sort_order(sort_field, order), 1, recall).drop("rank")
    hits = saved(hits.select("query_id", "id", "score").join(queries, "query_id")
                 .join(docs, "id").withColumn("exact", is_exact(F.col("query"))))
    kept = narrow(hits)
    totals = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    final = sort_order(sort_field, order) if sort_field else by_score()
    paged = page_of(rerank(kept) if rerank else kept, final, page, page_size).drop("exact")
    return _shared_answers(paged.join(totals, "query_id"), alike)


def by_score() -> list[Column]:
    return [F.col("score").desc_nulls_last(), F.col("last_seen_dt").desc_nulls_last(), F.col("id")]


def _asked_alike(queries: DataFrame) -> DataFrame:
    """The queries that ask for everything as (member, asked), and the ``query_id`` whose answer they share.

    That is the lowest id of the blank ones, or of those with an asterisk, which a document can bear as a name.
    """
    everything = queries.where(is_match_all(F.col("query")))
    star = F.coalesce(lower_key("query"), F.lit("")) == "*"
    first = F.when(star, everything.where(star).agg(F.min("query_id")).scalar()).otherwise(
        everything.where(~star).agg(F.min("query_id")).scalar())
    return saved(everything.select(F.col("query_id").alias("member"), F.col("query").alias("asked"), first.alias("query_id")))


def _shared_answers(paged: DataFrame, alike: DataFrame) -> DataFrame:
    """Give the page of a match-all query to every query that asks alike."""
    joined = paged.join(alike, "query_id", "left")
    return joined.withColumns({"query_id": F.coalesce("member", "query_id"),
                               "query": F.coalesce("asked", "query")}).drop("member", "asked")


# ---- suggestions -----------------------------------------------------------------

def _phrase_prefix(text: Column, prefix_tokens: Column) -> Column:
    """The tokens of the prefix occur in a row, the last one as a beginning."""
    line = F.concat(F.lit(" "), F.array_join(tokens(text), " "))
    wanted = F.concat(F.lit(" "), F.array_join(prefix_tokens, " "))
    return F.contains(line, wanted) & (F.size(prefix_tokens) > 0)


def suggest(docs: DataFrame, prefix: str, size: int = 5) -> DataFrame:
    """The ``size`` first terms that start with the prefix, over all matching documents.

    A document scores one per field that matches. Terms come by their best document,
    then by field order; they are case-sensitively distinct.
    """
    prefix = (prefix or "").strip()
    if not prefix:
        return docs.where(F.lit(False)).select(F.lit("").alias("term"), F.lit(0).alias("place"))
    asked = tokens(F.lit(prefix))
    matches = [_phrase_prefix(F.col(c), asked) for c in ("brand_name", "model_name", "search_text")]
    matches += [F.exists(c, lambda a: _phrase_prefix(a, asked)) for c in ("brand_aliases", "model_aliases")]
    matches.append(F.startswith("model_no", F.lit(prefix)))
    score = reduce(lambda a, b: a + b, [F.coalesce(m, F.lit(False)).cast("int") for m in matches])
    best = docs.withColumn("score", score).where(F.col("score") > 0)
    terms = best.select("score", "id", F.posexplode(F.concat(
        F.array("brand_name", "model_name", "model_no"), "brand_aliases", "model_aliases")).alias("pos", "term"))
    fitting = terms.where((F.col("term") != "")
                          & F.startswith(F.lower("term"), F.lit(prefix.lower())))
    firsts = fitting.groupBy("term").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "id", "pos")).alias("first"))
    return firsts.orderBy("first").limit(size).select(
        "term", F.row_number().over(W.orderBy("first")).alias("place"))
