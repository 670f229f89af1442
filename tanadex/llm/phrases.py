"""Collocations by sampling and a negative border: a sample proposes phrases, full passes count them exactly."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanadex.llm.common import saved

LONGEST = 4
LEAST = 30
COVER = 80
SCALE = 2_000_000
REPORT = 2000
NO_LANG = "und"
# One document in SHARE belongs to the sample, by a hash of its id; a phrase is proposed from SEEN occurrences there.
SHARE = 8
SEEN = 2
# Places of the filter of proposed phrases: 2^27 bits are 16 MB, whatever the corpus.
PLACES = 1 << 27
BUCKET = 1 << 15
# Bytes of text that are counted together, and rows that leave a task together.
BATCH_BYTES = 1_000_000
BATCH_ROWS = 20_000
SALTS = 64
WHOLE = "decimal(19,0)"
COUNTED = "h long, name binary, n long"


def _bytes_table() -> bytes:
    """A-Z become a-z; characters that end a piece become line ends; all other bytes stay."""
    ends = set(b".,;:!?\n\x0b\x0c\r")
    return bytes(10 if b in ends else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Filter:
    """A set of phrases by hash, as bits: it may hold phrases too many, never too few."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in places(h):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = h.astype(np.uint64)
    return h & np.uint64(PLACES - 1), (h >> np.uint64(32)) & np.uint64(PLACES - 1)


def bits_of(hashes: DataFrame) -> np.ndarray:
    """Bits at both places of every value of a column ``h``. The driver gets ``PLACES`` bits, however many there are."""
    at = F.explode(F.array(F.col("h").bitwiseAND(PLACES - 1), F.shiftrightunsigned("h", 32).bitwiseAND(PLACES - 1)))
    maps = hashes.select(at.alias("at")).groupBy(F.floor(F.col("at") / BUCKET).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("at").bitwiseAND(BUCKET - 1)).alias("bits"))
    bits = np.zeros(PLACES // 8, np.uint8)
    for r in maps.collect():  # PLACES / BUCKET rows at most
        bits[r["bucket"] * BUCKET // 8:(r["bucket"] + 1) * BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word and that of its last word."""
    with np.errstate(over="ignore"):
        h = (left * np.uint64(0x9E3779B97F4A7C15) + right) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


class Grams:
    """Distinct phrases of one length in a batch, and the phrase that begins at each position (-1: none)."""

    def __init__(self, at: np.ndarray, first: np.ndarray, after: np.ndarray, last: np.ndarray, h: np.ndarray, n: np.ndarray):
        # Each phrase by its part without the last word, its part without the first, and its last word.
        self.first, self.after, self.last = first, after, last
        self.at, self.h, self.n = at, h, n
        self.passes = np.ones(len(h), bool)


def batch_words(texts: list[tuple[str, bytes]]) -> tuple[list[tuple[str, bytes]], np.ndarray]:
    """Distinct (lang, word) pairs, and the numbers of the words in order; 0 stands between pieces."""
    numbers, known, flat = count(1), {}, []
    change = _bytes_table()
    for lang, text in texts:
        if lang not in known:
            known[lang] = {}
        own = known[lang]
        for piece in text.translate(change).split(b"\n"):
            words = piece.split()
            for w in words:
                if w not in own:
                    own[w] = next(numbers)
            if words:
                flat += map(own.__getitem__, words)
                flat.append(0)
    names = [("", b"")] + [(lang, w) for lang, own in known.items() for w in own]
    order = [0] + [k for own in known.values() for k in own.values()]
    placed: list = [None] * len(names)
    for k, name in zip(order, names):
        placed[k] = name
    return placed, np.array(flat, np.int64)


def batch_grams(words: list[tuple[str, bytes]], flat: np.ndarray, longest: int) -> Iterator[tuple[int, Grams]]:
    """Distinct phrases of a batch by length: every word, then every phrase whose parts without the first and the last
    word have been left with ``passes`` by the caller."""
    import xxhash
    seeds: dict[str, int] = {}
    h = np.zeros(len(words), np.uint64)
    for k, (lang, w) in enumerate(words[1:], 1):
        if lang not in seeds:
            seeds[lang] = xxhash.xxh64_intdigest(lang) & 0xFFFFFFFF
        h[k] = xxhash.xxh64_intdigest(w, seeds[lang])
    own, n = np.arange(len(words)), np.bincount(flat, minlength=len(words))
    n[0] = 0
    grams, single = Grams(np.where(flat > 0, flat, -1), own, own, own, h, n), h
    yield 1, grams
    for k in range(2, longest + 1):
        before, fit = grams, grams.passes
        begin = np.flatnonzero((before.at[:-1] >= 0) & (before.at[1:] >= 0))
        begin = begin[fit[before.at[begin]] & fit[before.at[begin + 1]]]
        key, inverse, n = np.unique(before.at[begin] * np.int64(len(before.h)) + before.at[begin + 1],
                                    return_inverse=True, return_counts=True)
        first, after = key // len(before.h), key % len(before.h)
        at = np.full(len(flat), -1)
        at[begin] = inverse
        last = before.last[after]
        grams = Grams(at, first, after, last, joined(before.h[first], single[last]), n)
        yield k, grams


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes]]]:
    texts, size = [], 0
    for batch in batches:
        langs, bodies = batch.column(0).to_pylist(), batch.column(1)
        for k, lang in enumerate(langs):
            text = bodies[k].as_buffer()
            texts.append((lang, text.to_pybytes() if text else b""))
            size += len(texts[-1][1])
            if size >= BATCH_BYTES:
                yield texts
                texts, size = [], 0
    if texts:
        yield texts


def _rows(h: np.ndarray, names: list[bytes] | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(n), BATCH_ROWS):
        part = slice(at, at + BATCH_ROWS)
        name = pa.nulls(len(n[part]), pa.binary()) if names is None else pa.array(names[part], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), name, pa.array(n[part], pa.int64())], ["h", "name", "n"])


class Spelling:
    """The phrases of a batch by growing length, and the texts of those of the current length."""

    def __init__(self, words: list[tuple[str, bytes]], flat: np.ndarray):
        self.words, self.flat = words, flat
        self.lang, langs = pd.factorize(np.array([x for x, _ in words], object))
        self.ends = [b"\n" + x.encode() for x in langs]
        self.levels: list[Grams] = []

    def totals(self) -> Iterator[pa.RecordBatch]:
        """Words of each language, under an empty phrase."""
        n = np.bincount(self.lang[self.flat[self.flat > 0]], minlength=len(self.ends)).astype(np.int64)
        some = np.flatnonzero(n)
        return _rows(np.zeros(len(some), np.uint64), [self.ends[i] for i in some], n[some])

    def grams(self) -> Iterator[tuple[int, Grams]]:
        for k, grams in batch_grams(self.words, self.flat, LONGEST):
            self.levels.append(grams)
            yield k, grams

    def names(self, pick: np.ndarray) -> list[bytes]:
        """Each picked phrase with its language: its last word, that of its part without it, back to the first one."""
        spelled, at = [], pick
        for grams in self.levels[::-1]:
            spelled.append([self.words[i][1] for i in grams.last[at].tolist()])
            start, at = at, grams.first[at]
        ends = [self.ends[i] for i in self.lang[start].tolist()]
        return [b" ".join(parts) + end for parts, end in zip(zip(*spelled[::-1]), ends)]


def sample_hashes(docs: DataFrame) -> DataFrame:
    """(h) of the phrases of up to ``LONGEST`` words that the sample holds ``SEEN`` times or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _batches(batches):
            for _, grams in batch_grams(*batch_words(texts), LONGEST):
                yield from _rows(grams.h[grams.n > 0], None, grams.n[grams.n > 0])
    part = docs.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), "text")), F.lit(SHARE)) == 0)
    counts = part.select("lang", "text").mapInArrow(run, COUNTED).groupBy("h").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= SEEN).select("h")


def _shared(docs: DataFrame, *bits: np.ndarray):
    return docs.sparkSession.sparkContext.broadcast([b.tobytes() for b in bits])


def counted(docs: DataFrame, proposed: np.ndarray) -> DataFrame:
    """(h, name, n): counts, over all documents, of the proposed phrases and of their negative border, that is, of every
    other phrase whose parts without the first and the last word are proposed.

    Proposed phrases are counted by their text: ``name`` is the phrase, a line end and the language. Those of the
    border, most of them rare, are counted by hash, with a null name. The words of each language stand under an empty
    phrase.
    """
    shared = _shared(docs, proposed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        [held] = [Filter(np.frombuffer(b, np.uint8)) for b in shared.value]
        for texts in _batches(batches):
            spelling = Spelling(*batch_words(texts))
            yield from spelling.totals()
            for _, grams in spelling.grams():
                grams.passes = held.holds(grams.h)
                pick = np.flatnonzero(grams.passes & (grams.n > 0))
                yield from _rows(grams.h[pick], spelling.names(pick), grams.n[pick])
                pick = np.flatnonzero(~grams.passes & (grams.n > 0))
                yield from _rows(grams.h[pick], None, grams.n[pick])
    return docs.select("lang", "text").mapInArrow(run, COUNTED).groupBy("h", "name").agg(F.sum("n").alias("n"))


def expanded(docs: DataFrame, proposed: np.ndarray, failures: np.ndarray) -> DataFrame:
    """(h, name, n): counts by text, over all documents, of the failures of the border and of every phrase around one:
    each of its parts without the first and the last word is proposed or holds a failure itself."""
    shared = _shared(docs, proposed, failures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, failed = (Filter(np.frombuffer(b, np.uint8)) for b in shared.value)
        for texts in _batches(batches):
            spelling, around = Spelling(*batch_words(texts)), None
            for k, grams in spelling.grams():
                own = failed.holds(grams.h)
                around = own if k == 1 else own | around[grams.first] | around[grams.after]
                grams.passes = held.holds(grams.h) | around
                pick = np.flatnonzero(around & (grams.n > 0))
                yield from _rows(grams.h[pick], spelling.names(pick), grams.n[pick])
    return docs.select("lang", "text").mapInArrow(run, COUNTED).groupBy("h", "name").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame) -> DataFrame:
    """(lang, k, phrase, n) of all phrases of up to ``LONGEST`` words with ``LEAST`` occurrences or more, exactly
    counted over ``docs`` (doc_id, lang, text), and of each language with k = 0 the number of its words.

    A frequent phrase of the border is a failure of the sample. A frequent phrase that was not counted by its text has
    a least part that was not proposed; all parts of that one were, so it lies in the border and is a failure. One
    expansion pass over all phrases around failures therefore closes the search. Phrases whose hashes collide can make
    a failure of rare ones; their texts are counted apart, so the result is exact.
    """
    proposed = bits_of(sample_hashes(docs))
    found = saved(counted(docs, proposed).where((F.col("n") >= LEAST) | (F.substring("name", 1, 1) == F.lit(b"\n"))))
    whole, failures = found.where(F.col("name").isNotNull()), found.where(F.col("name").isNull())
    if not failures.isEmpty():
        more = expanded(docs, proposed, bits_of(failures)).where(F.col("n") >= LEAST)
        # The filter of failures may hold phrases that the first pass has counted by text as well.
        whole = whole.unionByName(more).dropDuplicates(["h", "name"])
    name = F.col("name").cast("string")
    at = F.instr(name, "\n")
    rows = whole.select(F.substring(name, at + 1, F.length(name)).alias("lang"),
                        F.substring(name, F.lit(1), at - 1).alias("phrase"), "n")
    words = F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " "))
    return rows.select("lang", "phrase", "n", words.alias("words"), F.size(words).alias("k"))


def score_of(a: Column, left: Column, right: Column) -> Column:
    """SCALE * a / (l + r), rounded down; in decimals, since products and sums may pass 64 bits."""
    top, bottom = F.lit(SCALE).cast("decimal(7,0)") * a.cast(WHOLE), left.cast(WHOLE) + right.cast(WHOLE)
    return ((top - top % bottom) / bottom).cast("long")


def collocations(docs: DataFrame) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``REPORT`` phrases of each language of ``docs`` (doc_id, lang, text).

    A phrase has 2 to ``LONGEST`` words of one piece and ``LEAST`` occurrences or more. Its score is that of its weakest
    cut in two, SCALE * a / (l + r) rounded down; it goes if a longer phrase that holds it has ``COVER`` hundredths of its
    occurrences. A null lang counts as ``und``, a null or empty text has no words; repeated rows count each time; words
    and texts of any length are taken whole; an empty table gives no rows. Further columns are not looked at.
    """
    texts = docs.select("doc_id", F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = saved(frequent_phrases(texts))
    part = counts.where("k > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("m"))
    phrases = counts.where("k > 1")

    def run_of(start, length):
        return F.array_join(F.slice("words", start, length), " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    cuts = phrases.select("lang", "phrase", "words", F.col("n").alias("a"), "k", cut.alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", run_of(F.lit(1), F.col("cut")).alias("one"),
                       run_of(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("two"))
    left = part.select("lang", F.col("part").alias("one"), F.col("m").alias("l"))
    right = part.select("lang", F.col("part").alias("two"), F.col("m").alias("r"))
    scored = cuts.join(left, ["lang", "one"]).join(right, ["lang", "two"]).withColumn("score", score_of(F.col("a"), F.col("l"), F.col("r")))
    weakest = scored.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("cut"))
    length = F.explode(F.sequence(F.lit(2), F.col("k") - 1))
    inner = phrases.where("k > 2").select("lang", "words", "n", "k", length.alias("size"))
    inner = inner.select("lang", "words", "n", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("start"))
    covers = (inner.select("lang", run_of(F.col("start"), F.col("size")).alias("phrase"), "n")
              .groupBy("lang", "phrase").agg(F.max("n").alias("longer")))
    big = "decimal(24,0)"
    covered = F.coalesce(F.col("longer").cast(big) * 100 >= F.col("a").cast(big) * COVER, F.lit(False))
    kept = weakest.join(covers, ["lang", "phrase"], "left").where(~covered).withColumn("score", F.col("cut.score"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Two steps: no task orders all phrases of a language.
    salted = W.partitionBy("lang", "salt").orderBy(*best)
    first = (kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("place", F.row_number().over(salted))
             .where(F.col("place") <= REPORT))
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= REPORT)
    totals = counts.where("k = 0").select("lang", "n")
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a",
        F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", "score")
