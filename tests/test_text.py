import html
import re
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tanadex.functions import scalars, text
from tanadex.functions.transforms import apply_transforms
from tanadex.model import list_arguments, search_arguments
from tanadex.operators import quality


def values(spark, inputs, fn):
    rows = [(k, v) for k, v in enumerate(inputs)]
    out = spark.createDataFrame(rows, "k int, v string").select("k", fn(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(out)]


@pytest.mark.parametrize("lang,names", [
    ("en", ["Rolex", "Grand Seiko", "Daytona", "123", ""]),
    ("zh", ["劳力士", "格拉苏蒂", "迪通拿", "传承系列", "Rolex 劳力士"]),
    ("ja", ["ロレックス", "グランドセイコー", "デイトナ", "ヘリテージコレクション", "Rolex ロレックス"]),
])
def test_language(spark, lang, names):
    assert values(spark, names, text.detect_language) == [lang] * len(names)


@pytest.mark.parametrize("lang,expected", [("en", [False, True, True]), ("zh", [True, False, True]),
                                           ("ja", [True, True, False])])
def test_needs_translation(spark, lang, expected):
    assert values(spark, ["Rolex", "劳力士", "ロレックス"], lambda c: text.needs_translation(c, lang)) == expected
    assert values(spark, ["", None], lambda c: text.needs_translation(c, lang)) == [False, False]


def test_names_fold(spark):
    assert values(spark, ["ヴァシュロン・コンスタンタン", "A. Lange & Söhne", "A. Lange ＆ Söhne", "A. Lange &amp; Söhne",
                          "ＧＭＴ　マスター", "ｶﾞ–X", None],
                  text.normalize_text) == ["ヴァシュロンコンスタンタン", "ALange&Söhne", "ALange&Söhne", "ALange&Söhne",
                                           "GMTマスター", "ガ-X", ""]


def test_plain_path_equals_exact_path(spark):
    plain = ["a. b,c\td", "  x\x1cy\x0b", "No.1 (A/B)-c", ""]
    assert values(spark, plain, text.normalize_text) == [text.fold_name(p) for p in plain]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20))
def test_fold_is_the_stated_rule(name):
    folded = text.fold_name(name)
    assert not re.search(r"[\s,.・。、，·•‧∙]", folded)
    assert len(folded) <= len(unicodedata.normalize("NFKC", html.unescape(name)))


def test_strip_is_pythons(spark):
    odd = ["　 x 　", "\x1fx\x1c", " x\n", "x", " \n "]
    assert values(spark, odd, text.strip) == [s.strip() for s in odd]


def test_term_counts(spark):
    out = values(spark, ["b a b 爱马仕 a b", ""], lambda c: F.to_json(text.term_counts(text.tokens(c))))
    assert out == ['[{"term":"a","tf":2},{"term":"b","tf":3},{"term":"仕","tf":1},{"term":"爱","tf":1},'
                   '{"term":"马","tf":1}]', "[]"]


def test_prices(spark):
    assert values(spark, ["1,234,567", "¥1,234", "1234.5", None, "invalid", "-12.7", "", "1-2"],
                  scalars.normalize_price) == [1234567, 1234, 1234, None, None, -12, None, None]
    assert values(spark, ["1,2", "x", " 3.9 "], lambda c: scalars.safe_int(c, 7)) == [12, 7, 3]


def test_changed(spark):
    frame = spark.createDataFrame([(None, None), (None, 123), (123, 456), (123, 123)], "a int, b int")
    assert [r[0] for r in frame.select(scalars.price_changed("a", "b")).collect()] == [False, True, True, False]


def test_uid(spark):
    frame = spark.createDataFrame([("commit.example", "watch", " 12 "), ("s", "", "1"), (None, "c", "1")],
                                  "s string, c string, i string")
    uids = [r[0] for r in frame.select(scalars.source_uid("s", "c", "i")).collect()]
    assert uids == ["commit.example:watch:12", None, None]
    assert values(spark, ["a:b:c:d", "a:b"], lambda c: scalars.parse_source_uid(c)["item_id"]) == ["c:d", None]


def test_sites_and_images(spark):
    assert values(spark, ["https://a.example:80/x", "b.example/y", "https://u@c.example?q"], scalars.site_from_url) \
        == ["a.example", "b.example", "u@c.example"]
    assert values(spark, ["https://x/a.PNG?b=.gif", "https://x.jpeg/a", "https://x/a.tiff", "a.webp#x"],
                  scalars.image_type) == ["png", "jpg", "jpg", "webp"]
    assert values(spark, ["a/b", "x?y:z"], scalars.safe_name) == ["a_b", "x_y_z"]


def test_transforms(spark):
    def run(inputs, *specs):
        return values(spark, inputs, lambda c: apply_transforms(c, specs))
    join = {"type": "url_join", "base": "https://h.example/a/b?x=1"}
    assert run(["/p", "p", "?q", "#f", "//c.example/z", "ftp://k", "../up", "./", ""], join) == [
        "https://h.example/p", "https://h.example/a/p", "https://h.example/a/b?q", "https://h.example/a/b?x=1#f",
        "https://c.example/z", "ftp://k", "https://h.example/up", "https://h.example/a/", ""]
    assert run(["¥ 1,848,000", "none"], {"type": "regex_capture", "pattern": r"(?:¥\s*)?([0-9,]+)"},
               {"type": "replace", "config": {"from": ",", "to": ""}}, {"type": "to_int"}) == ["1848000", None]
    assert run(["https://x/shop/g/gik-00-0707255/"],
               {"type": "regex_capture", "pattern": "/([^/?#]+)/?$", "group": 1}) == ["gik-00-0707255"]
    assert run(["a.jpg 300w, b.jpg 600w", "a 1x,b 1x", "c.jpg", "d 1.5x, e 1x"], {"type": "pick_best_srcset"}) == [
        "b.jpg", "a", "c.jpg", "e"]
    assert run(["1,464,100", "1.5", " -3 "], {"type": "to_int"}) == ["1464100", None, "-3"]
    assert run(["x"], {"type": "unknown"}) == ["x"]


def test_arguments():
    assert list_arguments("bad", "bad", "xx", "bad") == {
        "status": "active", "category": None, "lang": "en", "sort": "first_seen_desc"}
    assert search_arguments("bad", "watch", "XXX")["status"] is None


def test_quality(spark):
    assert values(spark, ["None", " ", "x", None], quality.is_filled) == [False, False, True, False]
    assert values(spark, ["1,000", "1.5e3", "nan", "x", None], quality.is_number) == [True, True, True, False, False]
    assert values(spark, ["https://a", "/x", "a/b", "mailto:x"], quality.is_url) == [True, True, False, False]
    empty = spark.createDataFrame([], "a string")
    assert quality.completeness(empty, ["a"]).first()["completeness"] == 0.0
