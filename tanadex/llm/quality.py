"""Quality rules: word statistics of each text and a hashed n-gram log-likelihood ratio, in column functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tanadex.llm.common import words_of, wrapped

# Hash buckets of the multinomials: the whole model is so many numbers. Their number grows with the corpus, by powers of
# two from BUCKETS to MOST_BUCKETS: a small corpus fills each with FILL n-grams, so that clean texts outside the trusted
# ones do not score low for their own rare words, and a large one does not mix good and junk n-grams in few buckets.
BUCKETS = 1 << 10
MOST_BUCKETS = 1 << 14
FILL = 128
# Trusted documents are at most this many labelled rows, those of smallest hash.
TRUSTED_ROWS = 20_000
# A text is rejected if each n-gram is, in the mean, so much less likely (in nats) as trusted than as raw text.
THRESHOLD = -0.06
END = "\n"


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of documents labelled good and not toxic; of more than ``rows`` those of smallest hash.

    A null toxic label counts as not toxic; repeated labels count once.
    """
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def buckets_for(n_grams: int) -> int:
    """The number of buckets for a corpus of so many n-grams."""
    n = BUCKETS
    while n < MOST_BUCKETS and 2 * n * FILL <= n_grams:
        n *= 2
    return n


def bucket(n: int, *words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(n)).cast("int")


def word_grams(words: Column, n: int, value) -> Column:
    """``value(single, pair)`` of the buckets of ``n`` at each word; the last word is paired with an end mark."""
    return F.transform(words, lambda w, i: value(bucket(n, w), bucket(n, w, F.coalesce(F.get(words, i + 1), F.lit(END)))))


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log p(bucket | trusted) - log p(bucket | raw) for every bucket.

    Every document counts in the raw multinomial, with one more in each bucket. The trusted one has as many more
    n-grams as there are buckets, spread as the raw ones are, so with few or no trusted documents the ratios tend to
    zero. N-grams are counted once, in ``MOST_BUCKETS``; powers of two fold into ``buckets_for`` all of them, which is
    the length of the result.
    """
    # The trusted ids are bounded by TRUSTED_ROWS, so they may be broadcast.
    marked = docs.select("doc_id", words_of(F.col("text")).alias("words")).join(
        F.broadcast(trusted.withColumn("good", F.lit(1))), "doc_id", "left")
    grams = marked.select(F.explode(F.flatten(word_grams(F.col("words"), MOST_BUCKETS, F.array))).alias("b"),
                          F.coalesce("good", F.lit(0)).alias("good"))
    rows = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")).collect()
    n = buckets_for(sum(r.raw for r in rows))
    raw, good = [1] * n, [0] * n
    for r in rows:
        raw[r.b % n] += r.raw
        good[r.b % n] += r.good
    n_raw, n_good = sum(raw), sum(good)
    return [math.log((g * n_raw / r + n) / (n_good + n)) for g, r in zip(good, raw)]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``row`` plus words and the base statistics of each text.

    n_repeat_words: hashes of all three-word windows are sorted with their places; equal neighbours are windows
    found twice or more, and the distinct places they cover are counted. No row leaves its document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = wrapped(docs, text=text, words=words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    windows = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.struct(
        F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")))
    made = split.select("row", "text", "words", lines.alias("lines"), F.sort_array(windows).alias("windows"))
    again = F.filter("windows", lambda x, i: F.coalesce(x["h"] == F.get("windows", i - 1)["h"], F.lit(False))
                     | F.coalesce(x["h"] == F.get("windows", i + 1)["h"], F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return made.select(
        "row", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long")
        .alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``row`` of every document with its statistics, score and verdict.

    Score: mean over all n-grams (words and word pairs) of the trusted to raw log-ratio. ``kept`` is false if a base
    rule fails or the score is below the threshold; every document is judged by the same fixed rule. A null text has
    no words, score 0, and fails the base rules. Repeated rows are judged alike; without trusted labels every score is
    0, and the base rules alone decide.
    """
    # One text constant of a number for each bucket, which folds to one array constant.
    found = log_ratios(docs, trusted_ids(labels))
    ratios = F.split(F.lit(",".join(map(repr, found))), ",").cast("array<double>")
    total = F.aggregate(word_grams(F.col("words"), len(found), lambda a, b: F.get(ratios, a) + F.get(ratios, b)), F.lit(0.0),
                        lambda acc, x: acc + x)
    scored = with_statistics(docs).withColumn("score", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words")))
                                              .otherwise(0.0)).drop("words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with their own columns.

    A filter on columns alone would be pushed below the steps that make them and would work them out again for every
    word; one that also asks for a row number stays above.
    """
    judged = judge(docs, labels, threshold).select("row", "kept", F.monotonically_increasing_id().alias("at"))
    return judged.where("kept AND at >= 0").select("row.*")
