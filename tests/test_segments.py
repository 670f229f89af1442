"""The segmented index against a full rebuild, and a change of dictionary carried to its documents."""

import os

import pytest
from pyspark.sql import functions as F

from tanadex.operators import search, segments
from tanadex.operators.scale import saved
from tanadex.sources.dictionary import AliasDictionary
from tests.test_catalogue import CONFIG, dictionary, items  # noqa: F401


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def docs(items, dictionary):  # noqa: F811
    return saved(search.build_documents(items, dictionary))


def test_segments_equal_a_rebuild(spark, docs, tmp_path):
    index = segments.SegmentedIndex(spark, str(tmp_path / "index"))
    changed = docs.where("id % 2 = 0").withColumn("model_name", F.concat("model_name", F.lit(" new")))
    index.upsert(docs.where("id > 2")).upsert(changed).delete(docs.where("id = 4 or id = 5").select("id"))
    index.upsert(docs.where("id = 5 or id = 1"))
    odd = docs.where("id % 2 = 1")
    whole = odd.unionByName(changed.where("id <> 4"))
    expected = search.postings(whole)

    def same():
        assert rows(index.docs().select(whole.columns)) == rows(whole)
        assert rows(index.postings().select(expected.columns)) == rows(expected)
        assert rows(index.vocabulary()) == rows(search.vocabulary(expected))
        assert rows(index.field_stats()) == rows(search.field_stats(expected))
        assert rows(index.lookup(["new", "rolex", "zzz"]).select(expected.columns)) == rows(expected.where("term in ('new', 'rolex')"))
    same()
    queries = spark.createDataFrame([(1, "rolex new"), (2, "デイトナ")], "query_id long, query string")
    assert rows(search.match(queries, index.docs(), index=index.postings())) == rows(search.match(queries, whole))
    before = index.step
    index.compact()
    same()
    assert len(index.live) == 1
    again = segments.SegmentedIndex(spark, index.path).open(before)  # readers of the steps before still can
    assert len(again.live) == 4 and again.docs().count() == whole.count()
    small = {d: sum(os.path.getsize(os.path.join(p, f)) for p, _, fs in os.walk(f"{index.path}/{d}") for f in fs)
             for d in os.listdir(index.path) if d.startswith("seg=")}
    assert small["seg=2"] < small["seg=0"]  # a deletion writes tombstones, not postings


def test_affected_by_a_change_of_dictionary(spark, items, docs):  # noqa: F811
    """Added, removed and moved aliases, a renamed brand, reordered lists: as comparing all documents finds it."""
    def copy():
        import copy as c
        return c.deepcopy(CONFIG)
    changes = []
    one = copy(); one["Rolex"]["aliases"].append("ロレ"); changes.append(one)  # noqa: E702
    two = copy(); del two["Rolex"]["model_name"]["Daytona"]; changes.append(two)  # noqa: E702
    three = copy(); three["Audemars"] = three.pop("Audemars Piguet"); changes.append(three)  # noqa: E702
    four = copy(); four["Hermès"]["aliases"].reverse(); changes.append(four)  # noqa: E702
    five = copy(); five["Other"] = {"aliases": ["ROLEX"], "model_name": {}}; changes.append(five)  # noqa: E702
    changes += [copy(), {}]
    found = []
    for config in changes:
        new = AliasDictionary.from_config(spark, config)
        old = AliasDictionary.from_config(spark, CONFIG)
        got = {r.id for r in search.affected_by_dictionary(items, old, new).collect()}
        now = {r.id: r for r in search.build_documents(items, new).collect()}
        assert got == {r.id for r in docs.collect() if now[r.id] != r}, config
        found.append(len(got))
    assert found[-2] == 0 and sum(n > 0 for n in found) >= 4
