"""Operators that judge each text by itself: quality, language, tokens, personal data."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tanadex.llm import language, private, quality, tokens
from tests.llm.helpers import TINY, awkward, empty, frame, words


def _grams(ws):
    for w, after in zip(ws, [*ws[1:], quality.END]):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        yield (h - (h >> 63 << 64)) % quality.BUCKETS
        h = xxhash.xxh64_intdigest(after.encode(), h)
        yield (h - (h >> 63 << 64)) % quality.BUCKETS


def brute_quality(rows, trusted):
    raw, good = Counter(), Counter()
    for doc, text, *_ in rows:
        for b in _grams(words(text)):
            raw[b] += 1
            good[b] += doc in trusted
    n, n_good, n_raw = quality.BUCKETS, sum(good.values()), sum(raw.values()) + quality.BUCKETS
    ratio = lambda b: math.log((good[b] + n * (raw[b] + 1) / n_raw) / (n_good + n)) - math.log((raw[b] + 1) / n_raw)
    out = []
    for doc, text, *_ in rows:
        ws = words(text)
        wins = [tuple(ws[k:k + 3]) for k in range(len(ws) - 2)]
        seen = Counter(wins)
        repeat = len({k + j for k, w in enumerate(wins) if seen[w] > 1 for j in range(3)})
        lines = [x for x in (text or "").split("\n") if words(x)]
        score = sum(map(ratio, _grams(ws))) / (2 * len(ws)) if ws else 0.0
        failed = len(ws) < 50 or 100 * repeat > 50 * len(ws)
        out.append((doc, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
                    repeat, round(score, 9), failed, not failed and score >= quality.THRESHOLD))
    return out


def test_quality_against_brute_force(spark):
    rows = awkward(40) + [(50, "a b c\n" * 60, "en", "a", 1), (51, "same line\nsame line\n\nother", "en", "a", 1)]
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (105, 1, None), (106, 1, 1), (None, 1, 0), (107, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    judged = quality.judge(frame(spark, rows), labels)
    got = [(*r[:6], round(r.score, 9), *r[7:]) for r in judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept").collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(repr, got)) == sorted(map(repr, brute_quality(rows, {4, 105})))
    kept = quality.kept_documents(frame(spark, rows), labels)
    assert sorted(map(key, [(r.doc_id,) for r in kept.collect()])) == sorted(map(key, [(r[0],) for r in got if r[-1]]))
    assert quality.judge(empty(spark), labels.limit(0)).count() == 0
    assert all(r.score == 0 and r.kept != r.base_failed for r in quality.judge(frame(spark, rows), labels.limit(0)).collect())


def test_quality_keeps_good_and_drops_most_bad(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels).select("row.doc_id", "kept", "base_failed").join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.3 * len(bad)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_quality_buckets_grow_with_the_corpus(spark, size):
    """Junk of plain words does not hide in mixed buckets of a larger corpus, and good texts stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels).select("row.doc_id", "kept", "base_failed").join(labels, "doc_id").collect()
    plain = [r.kept for r in rows if r.quality == 0 and r.toxic == 0 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert plain and sum(plain) <= 0.1 * len(plain) and sum(bad) <= 0.2 * len(bad)
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)


def test_native_operators_have_no_python(spark):
    docs, labels = (spark.read.parquet(f"{TINY}/{t}.parquet") for t in ("documents", "labels"))
    from tanadex.llm import lines
    for made in (quality.kept_documents(docs, labels), lines.without_boilerplate(docs, F.col("source"), F.col("text"))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_tokens_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))
    rng = random.Random(3)
    bits = ["ab cd  e", "aaaa bbb", "▁ x▁▁", "漢字かな", "😀👍🏽 ", "\t\n\r\x00", "é̀ñß", "the and ing tion", "<s></s><unk><0x41>", "0123",
            "    ", "ﬁ㍿", "..--__==", "Ａｂ"]
    texts = ["".join(rng.choice(rng.choice(bits)) for _ in range(rng.choice([0, 1, 3, 8, 20, 60, 200]))) for _ in range(1500)]
    texts += [" " * n for n in range(40)] + [" " * n + "ﬁx" for n in range(40)] + ["a" * 5000, "ab" * 3000, "=-" * 3000, "漢字" * 2000]
    counter = tokens.Counter(public_tokenizers.path(tokens.MODEL))
    assert counter.count(texts) == [len(x) for x in model.encode(texts)]
    rows = awkward(10)
    got = tokens.token_counts(frame(spark, rows)).collect()
    want = [(d, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for d, t, *_ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert tokens.token_counts(empty(spark)).count() == 0


def test_all_segmentations_are_summed():
    pieces = language.Pieces(["a", "b", "ab", "aba", "ba"])
    p = np.array([[.2, .1], [.1, .3], [.3, .2], [.25, .1], [.15, .3], [language.STRAY] * 2, [0, 0]])
    number = {x: k for k, x in enumerate(pieces.names)}

    def brute(s, k):
        if not s:
            return 1.0
        return sum((p[number[s[:n]], k] if s[:n] in number else language.STRAY if n == 1 else 0) * brute(s[n:], k)
                   for n in range(1, min(3, len(s)) + 1))
    strings, weight, lang = ["a", "abab", "bxa", "aba", "b" * 9], np.array([1., 2, 1, 3, 1]), np.array([0, 1, 0, 1, 0])
    assert np.allclose(language.totals(strings, pieces, p), [[brute(s, 0), brute(s, 1)] for s in strings], rtol=1e-12)
    uses = language.expected(strings, pieces, p, weight, lang)
    step = 1e-6
    for piece in range(5):  # expected uses are p times the derivative of the log-likelihood
        for k in (0, 1):
            q = p.copy()
            q[piece, k] += step
            change = np.log(language.totals(strings, pieces, q)[:, k]) - np.log(language.totals(strings, pieces, p)[:, k])
            assert uses[piece, k] == pytest.approx(p[piece, k] * (weight * (lang == k) * change).sum() / step, abs=1e-3)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "12 !?", "fr"), (-3, "", None), (None, "the and of", None)], "doc_id long, text string, lang string")
    got = language.predictions(docs.unionByName(odd)).collect()
    assert len(got) == docs.count() + 4
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and r.doc_id in lang and r.lang_pred != "und"]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert {r.lang_pred for r in got if r.doc_id in (-1, -2, -3)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)


def test_language_without_anything_to_learn(spark):
    assert language.predictions(empty(spark)).count() == 0
    rows = language.predictions(frame(spark, [(1, "some text", None, "a", 1)])).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]


def brute_identifiers(t):
    def luhn(d):
        n = [int(c) for c in d[::-1]]
        return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(n)) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        out += [(m.start(), 2, m.end())] * (14 <= len(d) <= 19 and luhn(d))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_identifiers_equal_the_plain_patterns():
    rng = random.Random(1)
    bits = ["a", "1", "23", "255", ".", "@", "@b.c", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "é", "%", "\n", "+1 555 123 4567", "x.y@"]
    for _ in range(8000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert private.identifiers(t) == brute_identifiers(t)


@pytest.mark.parametrize("text, kind, found", [
    ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"),
    ("write john dot doe at mail7 dot example dot com", "email", "john dot doe at mail7 dot example dot com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("ｊohn＠example．com", "email", "ｊohn＠example．com"),
    ("jo​hn@example.com", "email", "jo​hn@example.com"),
    ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
    ("4111–1111–1111–1111", "card", "4111–1111–1111–1111"),
    ("at one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one")])
def test_disguises_are_found_where_they_stand(text, kind, found):
    base, every = private.spans_of(text)
    assert (kind, found) in [(private.KINDS[k], text[a:b]) for a, k, b in every]
    assert set(base) <= set(every)


def test_clean_text_has_no_spans(spark):
    for text in ("look at the dot. of the one", "(dot) (at)", "one two three", "at home dot", ""):
        assert private.spans_of(text) == ([], [])
    rows = awkward(5)
    got = {repr(r.doc_id): (r.n_email, r.spans) for r in private.personal_data(frame(spark, rows)).collect()}
    for d, t, *_ in rows:
        assert got[repr(d)] == (sum(k == 0 for _, k, _ in brute_identifiers(t or "")), private.written(private.spans_of(t or "")[1]))
    assert private.personal_data(empty(spark)).count() == 0


def test_long_words_after_two_spaces_are_counted_in_time():
    """A word of 200,000 characters behind a double space, repeated or of random letters, as the library counts it."""
    import time

    import public_tokenizers
    import sentencepiece
    path = public_tokenizers.path(tokens.MODEL)
    library, counter = sentencepiece.SentencePieceProcessor(model_file=path), tokens.Counter(path)
    rng = random.Random(6)
    texts = ["a  Fnq7" + "ab" * 100_000, "a   " + "x" * 50_000, "  the", "a  the  of", "b  ▁▁x", "a  漢 漢  é",
             "a  " + "".join(rng.choice("abcdefgh") for _ in range(20_000))]
    start = time.time()
    got = counter.count(texts)
    assert time.time() - start < 60
    assert got == [len(library.encode(t)) for t in texts]
