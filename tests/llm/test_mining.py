"""Hard negatives, byte-level BPE through the automaton, collocations: against plain versions and the library."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tanadex.llm import lexicon, negatives, phrases, queries
from tests.llm.helpers import TINY, awkward, empty, frame


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, label int"
    return spark.createDataFrame(rows, schema).select("*", F.lit(1).alias("rid"), F.lit(2).alias("score"), F.lit("x").alias("block"),
                                                      F.lit(0).alias("dim"), F.lit(None).cast("string").alias("part"))


def brute_negatives(rows, every):
    fit = [(v, [math.floor(256 * float(np.float32(x))) for x in e], lab) for v, e, lab in rows
           if v is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (anchor, q, label) in enumerate(fit):
        if anchor % every:
            continue
        score = [sum(a * b for a, b in zip(q, e)) for _, e, _ in fit]
        other = [j for j in range(len(fit)) if j != i and len(fit[j][1]) == len(q)]
        for j in sorted((j for j in other if fit[j][2] == label), key=lambda j: (-score[j], fit[j][0]))[:negatives.POSITIVES]:
            window = [m for m in other if fit[m][2] != label and 80 * score[j] <= 100 * score[m] <= 100 * score[j]]
            for rank, m in enumerate(sorted(window, key=lambda m: (-score[m], fit[m][0]))[:negatives.NEGATIVES], 1):
                out.append((anchor, fit[j][0], rank, fit[m][0], score[j], score[m]))
    return sorted(out)


def rows_of_vectors(seed=3, n=160, dim=6):
    rng = random.Random(seed)
    rows = [(k, [rng.uniform(-.2, 1) for _ in range(dim)], rng.choice([0, 0, 0, 1, 2])) for k in range(n)]
    rows += [(k, rows[20][1], 0) for k in range(300, 330)] + [(400 + k, rows[20][1], 1) for k in range(30)]  # ties
    rows += [rows[40], rows[40], (500, None, 1), (510, [None] * dim, 1), (520, [math.nan] * dim, 1), (530, [math.inf] * dim, 1),
             (540, rows[0][1], None), (None, rows[0][1], 1), (550, [], 1), (560, [], 2), (570, [1.0, 2.0], 1), (580, [0.0] * dim, 0),
             (590, [-x for x in rows[0][1]], 2), (600, [1.0, 2.5], 1), (610, [1.0, 2.0], 2)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_negatives_against_brute_force(spark, monkeypatch, small):
    if small:  # many blocks
        monkeypatch.setattr(negatives, "VECTOR_VALUES", 200)
        monkeypatch.setattr(negatives, "ANCHOR_VALUES", 40)
    rows = rows_of_vectors()
    got = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    want = brute_negatives(rows, 10)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_negatives_of_huge_components_and_none(spark):
    assert negatives.products(np.array([[3e20, 1.0]]), np.array([[3e20, 0.0], [-3e20, 0], [0.0, 7.0]])).tolist() == [
        [negatives.LONGS[1], negatives.LONGS[0], 7]]
    exact = np.array([[float(2 ** 27 + 1), 1.0]])
    assert negatives.products(exact, exact).tolist() == [[(2 ** 27 + 1) ** 2 + 1]]
    assert negatives.hard_negatives(vectors(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    alone = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)]
    assert negatives.hard_negatives(vectors(spark, alone), F.col("vec_id") % 10 == 0).count() == 0


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(lexicon.MODEL))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_texts():
    rng = random.Random(9)
    span = lambda: rng.choice([rng.randrange(32, 127), rng.randrange(128, 0x3000), rng.randrange(0x3000, 0xD7FF), rng.randrange(0xE000, 0x110000)])
    return ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext", "x" * 50_000, " " * 3000 + "a", "՘x\U0002fa20 ࢏1",
            "'s 're'LL don't I'd", "  a  b\n\n c\t 　x", "漢字" * 4000, "".join(rng.choice("abcdefgh") for _ in range(40_000)),
            "\x00\x01\x7f\x85   �"] + ["".join(chr(span()) for _ in range(150)) for _ in range(80)]


@pytest.mark.parametrize("size", [lexicon.FREQUENT, 50, 0])
def test_encoding_and_decoding_as_the_library(spark, library, monkeypatch, size):
    monkeypatch.setattr(lexicon, "BATCH_CHARS", 20_000)
    rows = awkward(40) + [(1000 + k, t, "en", "a", 1) for k, t in enumerate(odd_texts())]
    got = lexicon.decoded(lexicon.encoded(frame(spark, rows), size=size)).collect()
    want = Counter()
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in got) == want
    assert lexicon.decoded(lexicon.encoded(empty(spark))).count() == 0


def test_query_of_encoding(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_lexicon_bpe(spark, TINY).collect()}
    for r in spark.read.parquet(f"{TINY}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got.pop(r.doc_id) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
    assert not got


def test_decoding_of_broken_ids(spark, library):
    lists = [[50256, 0, 300], [220, 447], [447], [], None, [70_000, -1, 5]]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "doc_id long, ids array<int>")
    got = [r.text for r in lexicon.decoded(rows).orderBy("doc_id").collect()]
    assert got[:4] == [library.decode(x, skip_special_tokens=False) for x in lists[:4]]
    assert got[4] is None and got[5] == library.decode([5], skip_special_tokens=False)


def test_transducer_is_minimal_and_exact():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))).encode() for _ in range(700)})
    ids = {w: tuple(rng.randrange(4) for _ in range(rng.randint(1, 3))) for w in words}
    read = lexicon.Lexicon(lexicon.compiled(sorted(ids.items())))
    asked = words + [w + b"a" for w in words] + [b"", b"zzz"]
    known, n, flat = read.look_up(asked)
    ends = np.cumsum(n)
    for w, yes, a, b in zip(asked, known, ends - n, ends):
        assert yes == (w in ids) and tuple(flat[a:b]) == ids.get(w, ())
    # Words that put out alike share their ends: states for all suffixes, not for all words.
    same = lexicon.Lexicon(lexicon.compiled([(w, (1,)) for w in sorted(a + b for a in (b"a", b"b", b"c") for b in (b"xyz", b"xyq"))]))
    assert len(same.final) == 5 and same.look_up([b"bxyq"])[2].tolist() == [1]
    assert not lexicon.Lexicon(lexicon.compiled([])).look_up([b"a"])[0].any()


def test_frequent_words_keep_to_their_bound(spark):
    texts = spark.createDataFrame([(" ".join(f"w{k}" for k in range(n)),) for n in range(1, 60)], "text string")
    assert 0 < lexicon.frequent_words(texts, 20).count() <= 20


def brute_collocations(rows):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or ("und" if lang is None else lang)
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i:i + k])) for k in range(1, 5) for i in range(len(ws) - k + 1))
    out = []
    cand = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= phrases.LEAST}
    cover = Counter()
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                cover[lang, p[i:i + k]] = max(cover[lang, p[i:i + k]], a)
    for (lang, p), a in cand.items():
        if (lang, p) in cover and 100 * cover[lang, p] >= 80 * a:
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                                    for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:phrases.REPORT]
        ranked += [(r[0], k, *r[1:]) for k, r in enumerate(own, 1)]
    return sorted(ranked)


def phrase_rows():
    rng = random.Random(11)
    vocab = ["The", "of", "a", "Été", "漢字", "x" * 400, "new", "york", "city"] + [f"w{k}" for k in range(25)]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice(["  ", " ", "\t", " ", ", ", ".\n"]) for _ in range(n))
    rows = awkward(10) + [(200 + k, text(rng.randint(0, 200)) + " New york City hall", rng.choice(["en", "en", "fr", None, "und", ""]), "a", 1)
                          for k in range(120)]
    return rows + [(900 + k, "same old story here again. " * 3, "de", "a", 1) for k in range(40)]


@pytest.mark.parametrize("share, seen, places", [(phrases.SHARE, phrases.SEEN, phrases.PLACES), (50, 2, 1 << 27), (1 << 40, 1, 1 << 27),
                                                 (4, 3, 1 << 15)])
def test_collocations_against_brute_force(spark, monkeypatch, share, seen, places):
    """Whatever the sample proposes, even nothing, and however full the filter: the result is the same."""
    for name, value in (("SHARE", share), ("SEEN", seen), ("PLACES", places), ("REPORT", 60)):
        monkeypatch.setattr(phrases, name, value)
    rows = phrase_rows()
    got = sorted(map(tuple, phrases.collocations(frame(spark, rows)).collect()))
    want = brute_collocations(rows)
    assert got == want and len({r[0] for r in want}) >= 3
    assert phrases.collocations(empty(spark)).count() == 0


def test_scores_beyond_64_bits(spark):
    value = spark.range(1).select(phrases.score_of(F.lit(9 * 10 ** 18), F.lit(9 * 10 ** 18), F.lit(9 * 10 ** 18))).first()[0]
    assert value == 2_000_000 * 9 * 10 ** 18 // (18 * 10 ** 18)
