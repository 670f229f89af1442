"""Ranked retrieval over blocks of documents: blocks whose best possible score cannot reach the page are not scored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanadex.operators import search
from tanadex.operators.scale import saved

# Documents to a block.
BLOCK = 1024
# Ranges of names that are cut into blocks side by side.
RANGES = 1024
# Pages whose worth of documents, by blocks that can bring most, gives a query its threshold.
FIRST_PAGES = 4
# Room for rounded scores and for sums in another order.
SLACK = 1e-5


@dataclass(frozen=True)
class RankedIndex:
    """Stored postings in blocks, each document's block, document counts of the terms, and statistics of the fields."""

    blocks: DataFrame
    places: DataFrame
    terms: DataFrame
    stats: DataFrame


def _gain(avg: Column) -> Column:
    tf = F.col("tf")
    return tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * F.col("doc_len") / avg))


def build_index(docs: DataFrame, block: int = BLOCK) -> RankedIndex:
    """One row for each term, field and block: the postings, and the largest gain that any of them can bring.

    Blocks hold ``block`` documents in order of their names, so that a name's terms are dense in few blocks and absent
    from others, and a block's rows stay small however frequent a term or a name is.
    """
    ranges = min(RANGES, docs.count() // block + 1)
    order = ["brand_name", "model_name", "id"]
    near = docs.select(*order).repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id().cast("bigint"))
    nth = F.floor((F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1) / block)
    places = saved(near.select("id", (F.col("part") * (1 << 32) + nth).alias("block")))
    rows = saved(search.postings(docs))
    stats = saved(search.field_stats(rows))
    placed = rows.join(stats.select("field", "avg_len"), "field").join(places, "id").select(
        "field", "term", "block", "id", _gain(F.col("avg_len")).alias("gain"))
    blocks = saved(placed.groupBy("field", "term", "block").agg(
        F.max("gain").alias("gain"), F.count(F.lit(1)).alias("n"), F.collect_list("id").alias("ids"),
        F.collect_list(F.struct("id", "gain")).alias("entries")))
    terms = saved(blocks.groupBy("field", "term").agg(F.sum("n").alias("df")))
    return RankedIndex(blocks, places, terms, stats)


def _weights(queries: DataFrame, index: RankedIndex, fuzzy: bool) -> DataFrame:
    """(query_id, field, term, w): the index terms that stand for a query's terms, weighted by rarity."""
    asked = search._expanded(search.query_terms(queries), index.terms.select("field", "term"), fuzzy)
    asked = asked.groupBy("query_id", "field", F.col("match").alias("term")).agg(F.sum(F.col("repeats") * F.col("weight")).alias("weight"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return (asked.join(index.terms, ["field", "term"]).join(index.stats.select("field", "n_docs"), "field")
            .select("query_id", "field", "term", (F.col("weight") * idf).alias("w")))


def _best_field(gain: str) -> Column:
    sums = [F.coalesce(F.sum(F.when(F.col("field") == f, F.col("w") * F.col(gain))), F.lit(0.0)) * boost
            for f, boost in search.BOOSTS.items()]
    return F.greatest(*sums)


def _scores(chosen: DataFrame, met: DataFrame, index: RankedIndex) -> DataFrame:
    """(query_id, id, score) of all documents that match in the chosen (query_id, block)."""
    entries = (met.join(chosen, ["query_id", "block"], "left_semi").select("query_id", "block", "field", "term", "w")
               .join(index.blocks.select("field", "term", "block", "entries"), ["field", "term", "block"])
               .select("query_id", "field", "w", F.explode("entries").alias("e")).select("query_id", "field", "w", "e.id", "e.gain"))
    return entries.groupBy("query_id", "id").agg(F.round(_best_field("gain"), search.SCORE_DIGITS).alias("score"))


@dataclass(frozen=True)
class Search:
    """The rows of a page, and what it took: ``met`` blocks by query, of which ``scored`` were read."""

    rows: DataFrame
    met: DataFrame
    scored: DataFrame


def search_page(queries: DataFrame, docs: DataFrame, index: RankedIndex, page: int = 1, page_size: int = 20,
                fuzzy: bool = True) -> Search:
    """The answer of ``search.search`` by score, for queries that do not ask for everything, without scoring every hit.

    A block can bring a query no more than the weighted largest gains of its terms there. The blocks that can bring
    most, as many as hold a few pages, are scored first and give a score that the page's last row reaches at least; blocks that cannot reach it
    are left out, so the page is exact, ties included. If a query has exact hits, only those count, and only blocks that
    hold one. Totals count those, or else come from the ids of the blocks, without scores.
    """
    wanted = page * page_size
    asked = queries.where(~search.is_match_all(F.col("query")))
    exact = saved(search.exact_pairs(asked, docs))
    narrowed = saved(exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact")))
    met = saved(_weights(asked, index, fuzzy).join(index.blocks.select("field", "term", "block", "gain", "n"), ["field", "term"]))
    exact_blocks = exact.join(index.places, "id").groupBy("query_id", "block").agg(F.count(F.lit(1)).alias("holds"))
    # A block holds at least as many hits as one of its terms has documents, or as it has exact ones.
    bounds = saved(met.groupBy("query_id", "block").agg(_best_field("gain").alias("bound"), F.max("n").alias("n"))
                   .join(exact_blocks, ["query_id", "block"], "left").join(narrowed, "query_id", "left")
                   .where(F.col("holds").isNotNull() | F.col("n_exact").isNull())
                   .select("query_id", "block", "bound", F.coalesce("holds", "n").alias("n")))

    def allowed(hits: DataFrame) -> DataFrame:
        marked = hits.join(exact.withColumn("exact", F.lit(True)), ["query_id", "id"], "left").join(narrowed, "query_id", "left")
        return marked.where(F.col("exact") | F.col("n_exact").isNull()).drop("exact", "n_exact")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    before = F.sum("n").over(W.partitionBy("query_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1))
    first = (bounds.withColumn("k", place).where(F.col("k") <= FIRST_PAGES * wanted).withColumn("before", F.coalesce(before, F.lit(0)))
             .where(F.col("before") < FIRST_PAGES * wanted).select("query_id", "block"))
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    reached = allowed(_scores(first, met, index)).withColumn("k", order).where(F.col("k") == wanted).select("query_id", "score")
    scored = saved(bounds.join(reached, "query_id", "left").where(
        F.col("score").isNull() | (F.col("bound") >= F.col("score") - SLACK)).select("query_id", "block"))
    hits = allowed(_scores(scored, met, index)).join(docs.select("id", "last_seen_dt"), "id")
    paged = search.page_of(hits, search.by_score(), page, page_size).drop("last_seen_dt")
    held = (met.join(narrowed, "query_id", "left_anti").select("query_id", "field", "term", "block").join(index.blocks.select("field", "term", "block", "ids"), ["field", "term", "block"])
            .groupBy("query_id", "block").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("n")))
    totals = held.groupBy("query_id").agg(F.sum("n").alias("total")).unionByName(
        narrowed.withColumnRenamed("n_exact", "total"))
    rows = paged.join(totals, "query_id").join(queries, "query_id").join(docs, "id")
    return Search(rows, met.select("query_id", "block").distinct(), scored)


def search_ranked(queries: DataFrame, docs: DataFrame, index: RankedIndex, page: int = 1, page_size: int = 20,
                  fuzzy: bool = True) -> DataFrame:
    """``search_page`` for all queries; those that ask for everything share one answer."""
    found = search_page(queries, docs, index, page, page_size, fuzzy).rows
    every = queries.where(search.is_match_all(F.col("query")))
    nothing = search.postings(docs.limit(0))
    rest = search.search(every, docs, page, page_size, fuzzy=False, index=nothing)
    return found.unionByName(rest.select(found.columns))
