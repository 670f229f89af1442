"""Small tables with awkward rows, and plain readings of words, for the brute-force tests."""

from __future__ import annotations

import random
import re

TINY = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def awkward(extra: int = 0, seed: int = 5):
    """Nulls in every column, empty and blank texts, copies, near copies, a very long text and repeated rows."""
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "Tion", "erst,", "naïve", "ß", "漢字", "x" * 300, "a@b.cd", "###", "nd."]
    vocab += ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = text(120), text(60)
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", None, None, 4), (None, text(80), "fr", "b", 1),
            (4, base, "en", "a", 1), (5, base, "en", "a", 1), (6, base + " end", "en", "b", 1), (7, text(30) + "\n" + passage, None, "a", 1),
            (8, passage + " " + passage, "de", None, 1), (8, passage + " " + passage, "de", None, 1), (9, text(9000), "en", "a", 1),
            (10, "one", "en", "c", 3), (11, "two words", "en", "a", 9), (12, "12 345 !!", "en", "a", 9)]
    rows += [(100 + k, text(rng.randint(0, 150)), rng.choice(["en", "fr"]), rng.choice("abcde"), 1) for k in range(extra)]
    return rows


def frame(spark, rows):
    """Documents with further columns whose names operators use inside."""
    from pyspark.sql import functions as F
    return spark.createDataFrame(rows, SCHEMA).select(
        "*", F.lit(1).alias("row"), F.lit("x").alias("words"), F.lit(None).cast("string").alias("host"), F.lit(2).alias("size"),
        F.lit(3).alias("rid"), F.lit(True).alias("kept"), F.lit("y").alias("lines"), F.lit(0).alias("item"))


def empty(spark):
    return frame(spark, [])
