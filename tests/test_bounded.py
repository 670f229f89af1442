"""Ranked retrieval with bounds against scoring every hit."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tanadex.operators import bounded, search
from tanadex.operators.scale import saved


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta 時計 ロレ omega x1 steel".split())
    rows = []
    for k in range(1, 1500):
        brand, model = word(), " ".join(word() for _ in range(rng.choice([1, 1, 2, 3, 30])))
        aliases = [brand.upper(), word()]
        no = f"P{k}" if k % 5 else ""
        text = " ".join([*aliases, model, no])
        rows.append((k * 1009, brand if k % 50 else None, model if k % 41 else "", no, dt.date(2024, 1, 1 + k % 28) if k % 9 else None,
                     aliases, [model, word()], text))
    frame = spark.createDataFrame(rows, "id long, brand_name string, model_name string, model_no string, last_seen_dt date, "
                                        "brand_aliases array<string>, model_aliases array<string>, search_text string")
    extra = [F.lit(None).cast(t).alias(c) for c, t in (("price", "bigint"), ("currency", "string"), ("site", "string"), ("category", "string"),
                                                       ("status", "string"), ("image_thumb_300_key", "string"), ("product_url", "string"),
                                                       ("created_at", "timestamp"))]
    return saved(frame.select("*", *extra))


QUERIES = ["alpha", "gamma steel", "p7", "P7", "omega omega x1", "stele", "zzz", "#", "時計", "ALPHA", "beta gamma delta", "", "*",
           "alpha beta gamma delta omega"]


@pytest.mark.parametrize("fuzzy, page, size", [(True, 1, 5), (False, 2, 3), (False, 1, 100)])
def test_pages_equal_scoring_every_hit(spark, docs, fuzzy, page, size):
    queries = spark.createDataFrame(list(enumerate(QUERIES, 1)), "query_id long, query string")
    index = bounded.build_index(docs, 16)
    columns = ["query_id", "id", "score", "rank", "total", "query", "brand_name"]
    want = search.search(queries, docs, page, size, fuzzy=fuzzy).select(columns).collect()
    got = bounded.search_ranked(queries, docs, index, page, size, fuzzy).select(columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and want


def test_blocks_out_of_reach_are_not_scored(spark, docs):
    """With many brands and words, most blocks hold some word of a query and few can reach its page."""
    word = lambda col, seed, n: F.concat(F.lit(col), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("string"))
    named = (docs.withColumns({"brand_name": word("b", 1, 40), "model_name": F.concat_ws(" ", word("m", 2, 60), word("m", 3, 60)),
                               "model_no": F.lit("")})
             .withColumns({"brand_aliases": F.array("brand_name"), "model_aliases": F.array("model_name"),
                           "search_text": F.concat_ws(" ", "brand_name", "model_name")}))
    named = saved(named)
    asked = [(k, f"b{k} m{3 * k} m{5 * k % 60}") for k in range(10)] + [(20, "b7")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    found = bounded.search_page(queries, named, bounded.build_index(named, 16), 1, 5, fuzzy=False)
    want = search.search(queries, named, 1, 5, fuzzy=False).select("query_id", "id", "score", "rank", "total")
    assert sorted(map(str, found.rows.select(want.columns).collect())) == sorted(map(str, want.collect()))
    met, scored = ({r.query_id: r["count"] for r in x.groupBy("query_id").count().collect()} for x in (found.met, found.scored))
    assert all(0 < scored[k] <= met[k] for k in met) and sum(scored.values()) < 0.75 * sum(met.values()), (scored, met)


def test_nothing_to_search(spark, docs):
    none = docs.limit(0)
    queries = spark.createDataFrame([(1, "alpha"), (2, "*")], "query_id long, query string")
    assert bounded.search_ranked(queries, none, bounded.build_index(none)).count() == 0
    assert bounded.search_ranked(queries.limit(0), docs, bounded.build_index(docs)).count() == 0


@pytest.mark.parametrize("fuzzy", [True, False])
def test_narrowed_hits_equal_judging_every_hit(spark, docs, fuzzy):
    """Exact hits by equality of keys and the words of the other queries give what judging each hit gives."""
    stars = docs.limit(700).unionByName(docs.limit(3).withColumns({"id": -F.col("id"), "brand_name": F.lit(" * ")}))
    asked = QUERIES + ["P15 ", "ロレ", "alpha x", "delt"]
    for rows, texts in ((docs, asked), (stars, asked), (stars, [q for q in asked if q != ""])):
        queries = spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, query string")
        hits = search.match(queries, rows, fuzzy).unionByName(search.match_all(queries, rows))
        judged = hits.join(rows, "id").join(queries, "query_id").withColumn("exact", search.is_exact(F.col("query")))
        want = search.narrow(judged).select("query_id", "id", "exact").collect()
        got = search.narrowed_hits(queries, rows, fuzzy).select("query_id", "id", "exact").collect()
        assert sorted(got) == sorted(want) and want


def test_every_query_for_all_is_answered(spark, docs):
    """Each blank query and each asterisk has its own hits: all documents, or those that bear the asterisk as a name."""
    few = saved(docs.limit(50))
    named = few.limit(2).withColumns({"id": -F.col("id"), "brand_name": F.lit(" * ")})
    texts = ["", "*", "  ", " * ", None, "\u3000*", "alpha", "*"]
    queries = spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, query string")
    every = {k: (q or "").strip() for k, q in enumerate(texts, 1) if q != "alpha"}
    for rows in (few, saved(few.unionByName(named))):
        ids = {r.id for r in rows.select("id").collect()}
        stars = {i for i in ids if i < 0} or ids
        want = {k: stars if q else ids for k, q in every.items()}
        everything = search.match_all(queries, rows).collect()
        assert sorted((r.query_id, r.id, r.score) for r in everything) == sorted((k, i, 1.0) for k in every for i in ids)
        got = [r for r in search.narrowed_hits(queries, rows, False).collect() if r.query_id in every]
        assert sorted((r.query_id, r.id) for r in got) == sorted((k, i) for k, found in want.items() for i in found)
        assert all(r.exact == (len(want[r.query_id]) < len(ids)) for r in got)
        paged = search.search(queries, rows, 1, 100, fuzzy=False).where(F.col("query_id") != 7).select("query_id", "id", "query", "total").collect()
        assert sorted((r.query_id, r.id, r.query or "", r.total) for r in paged) == sorted(
            (k, i, texts[k - 1] or "", len(found)) for k, found in want.items() for i in found)


def test_few_queries_for_all_go_to_the_documents(spark, docs):
    """The queries that ask for all are stored, so that few of them are broadcast, however many others there are."""
    queries = spark.range(1 << 20).select(F.col("id").alias("query_id"), F.when(F.col("id") % 100_000 == 0, "*").otherwise("x").alias("query"))
    found = search.match_all(saved(queries), docs)
    assert found.count() == 11 * docs.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" in plan


def test_hits_are_summed_where_postings_lie(spark, docs, monkeypatch):
    """Postings are dealt by document in tasks of bounded size; the many hits take no shuffle of their own."""
    queries = spark.createDataFrame(list(enumerate(QUERIES, 1)), "query_id long, query string")
    want = search.match(queries, docs, fuzzy=False).collect()
    monkeypatch.setattr(search, "TASK_POSTINGS", 1000)
    found = search.match(queries, docs, fuzzy=False)
    assert sorted(found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "hashpartitioning(id" in plan and found.rdd.getNumPartitions() > 9


def test_totals_of_exact_queries_read_no_ids(spark, docs):
    """Queries with exact hits are counted by those; their blocks' ids are left alone."""
    queries = spark.createDataFrame([(1, "alpha"), (2, "stele")], "query_id long, query string")
    found = bounded.search_page(queries, docs, bounded.build_index(docs, 16), 1, 5)
    want = search.search(queries, docs, 1, 5).select("query_id", "id", "total").collect()
    assert sorted(found.rows.select("query_id", "id", "total").collect()) == sorted(want)
    assert "LeftAnti" in found.rows._jdf.queryExecution().optimizedPlan().toString()
