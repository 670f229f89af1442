"""Numbering, repeated keys, and functions sent to executors."""

import os
import random
import subprocess
import sys

from pyspark.sql import functions as F

from tanadex.operators.scale import dense_number, quantile_number
from tanadex.sources.files import parse_key_value_text

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_rows_without_a_key_are_numbered_first(spark):
    rows = spark.createDataFrame([(5, 1), (None, 2), (None, 1), (1 << 40, 1), (-3, 1)], "k long, pos int")
    got = dense_number(rows, "k", "pos", name="n").orderBy("n").collect()
    assert [(r.k, r.pos, r.n) for r in got] == [(None, 1, 1), (None, 2, 2), (-3, 1, 3), (5, 1, 4), (1 << 40, 1, 5)]


def test_sparse_keys_fall_into_even_ranges(spark):
    """Random 64-bit keys, repeated and null ones: numbered as a sort numbers them, and no range holds many."""
    rng = random.Random(1)
    keys = [rng.randrange(-2 ** 63, 2 ** 63) for _ in range(20_000)] + [None, None] + [7] * 5
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k long, pos int").repartition(8)
    got = quantile_number(rows, "k", "pos", name="n", start=11).orderBy("n").collect()
    want = sorted(((k, n) for n, k in enumerate(keys)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.k, r.pos, r.n) for r in got] == [(*w, 11 + i) for i, w in enumerate(want)]
    plan = quantile_number(rows, "k", "pos", name="n")
    assert quantile_number(rows.limit(0), "k", name="n").count() == 0 and plan.count() == len(keys)
    import bisect
    bounds = rows.agg(F.percentile_approx("k", [i / 256 for i in range(1, 256)], 10_000)).first()[0]
    sizes = [0] * 256
    for k in keys:
        if k is not None:
            sizes[bisect.bisect_right(bounds, k)] += 1
    assert max(sizes) < 3 * len(keys) / 256


def test_compact_tables_are_dealt_by_rows(spark, monkeypatch):
    """Costly work on a table of few bytes has tasks of bounded rows, and a page's linked data is parsed once."""
    from tanadex.operators import scale
    from tanadex.plans.registry import QUERIES
    import tanadex.plans.extraction, tanadex.plans.searching  # noqa: E401, F401
    monkeypatch.setattr(scale, "TASK_ROWS", 50)
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    for name in ("postings", "extract_jsonld"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == parts // 50 + 1, name
    plan = QUERIES["extract_jsonld"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_lookups_are_stored_once(spark):
    """Lookup tables are files of known size when a join with them is planned."""
    from tanadex.sources.dictionary import AliasDictionary
    known = AliasDictionary.from_config(spark, {"Rolex": {"aliases": ["R"], "model_name": {"Daytona": {"aliases": ["D"]}}}})
    assert known.brand_lookup("exact").inputFiles() and known.model_lookup("folded").inputFiles()


def test_last_line_of_a_repeated_key_counts(spark):
    text = spark.createDataFrame([("a: 1\nb: 2\na: 3",)], "t string")
    assert text.select(parse_key_value_text(F.col("t")).alias("m")).first().m == {"a": "3", "b": "2"}


CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from tanadex.functions.text import match_key
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from pyspark.sql import functions as F
row = spark.createDataFrame([("Ａ. Lange ＆ Söhne",)], "t string").select(match_key("t").alias("k")).first()
print("FOUND", row.k)
"""


def test_functions_load_where_the_package_is_not(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True,
                          text=True, timeout=180)
    assert "FOUND" in done.stdout, done.stderr[-800:]


def test_all_character_references_are_decoded(spark):
    from tanadex.functions.strategies import decode_entities
    cases = {"&#x000027;": "'", "&#x10FFFD;": "\U0010fffd", "&#0000039;": "'", "&euro;&copy;&eacute;": "€©é", "&amp;lt;": "&lt;",
             "a & b &nope; &#xD800; &#99999999; &#0;": "a & b &nope; &#xD800; &#99999999; &#0;", "x&nbsp;y": "x y", "&#38;lt;": "&lt;"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.d for r in rows.select("t", decode_entities(F.col("t")).alias("d")).collect()}
    assert got == cases


def test_values_in_deep_lists_are_found(spark):
    from tanadex.functions.strategies import json_path
    deep = '[1, ["x"], [[[[[[{"b": 0}, {"a": {"c": 7}}]]]]]], {"a": {"c": 8}}]'
    rows = spark.createDataFrame([(deep,), ('{"a": {"c": 5}}',), ("[]",), ("[[",)], "t string")
    assert [r.v for r in rows.select(json_path(F.col("t"), "a.c").alias("v")).collect()] == ["7", "5", None, None]
