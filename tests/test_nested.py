"""Elements that hold each other, against a stack over the tags."""

import random
import re

from pyspark.sql import functions as F

from tanadex.functions.strategies import elements, nested_elements
from tanadex.operators import extract
from tanadex.sources import rules


def by_stack(markup, tag):
    """Whole elements in order of their beginnings, by pairing each end with the last open beginning."""
    stack, depth, found = [], 0, []
    for m in re.finditer(rf"(?i)<{tag}(?=[\s/>])[^<]*|</{tag}\s*>", markup):
        if m.group().startswith("</"):
            depth -= 1
            if stack:
                found.append((stack[-1][0], stack.pop()[1], m.end()))
        else:
            stack.append((m.start(), depth))
            depth += 1
    return [(level, markup[a:b]) for a, level, b in sorted(found)]


def test_nested_elements_against_a_stack(spark):
    rng = random.Random(3)
    parts = ["<li>", "<LI class='x'>", "</li>", "</li >", "</Li>", "a", "<b>", "<lix>", "</ul>", "é漢", "<li/>", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += ["", "<li>", "</li>", "<li>" * 400 + "x" + "</li>" * 400, "</li></li><li>a</li>"]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "id long, t string")
    for r in rows.select("id", nested_elements(F.col("t"), "li").alias("e")).collect():
        if r.id == len(texts):
            assert r.e is None
        else:
            assert [(e.level, e.markup) for e in r.e] == by_stack(texts[r.id], "li"), texts[r.id]


def test_rules_address_nested_items(spark):
    page = "<ul><li><a href='/1'>A</a><ul><li><a href='/2'>B</a></li></ul></li><li><a href='/3'>C</a></li></ul>"
    rule = {"name": "n", "match": {"url_regex": "."}, "parse": {"type": "list", "item_patterns": ["nested:li@0"], "fields": {
        "link": {"pattern": r"<a\s[^>]*>.*?</a>", "attr": "href"}, "inner": {"patterns": ["nested:li@1", ":root"], "text": True}}}}
    pages = spark.createDataFrame([(1, "http://x.example/", page, 200)], "page_id long, url string, html string, status_code int")
    items = extract.explode_items(extract.extract_records(pages, [rules.parse_profile(rule)])).orderBy("pos").collect()
    assert [r["item"]["link"] for r in items] == ["/1", "/3"]
    one = spark.createDataFrame([(page,)], "t string").select(elements(F.col("t"), ["nested:p", "nested:li"]).alias("e")).first().e
    assert [e[:15] for e in one] == ["<li><a href='/1", "<li><a href='/2", "<li><a href='/3"]
