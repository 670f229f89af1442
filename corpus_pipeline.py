"""From raw documents to packed training sequences: five stages over the operators of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``documents``. Between stages the documents are written as Parquet below the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tanadex.llm import lines, mixing, packing, quality, simhash
from tanadex.llm.common import saved, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# A source is far larger than a host of pages, so its repeated lines stand on a smaller share of its documents. A line is
# dropped on more than this share of a source's documents (and no fewer than lines.MIN_PAGES), if it has so many words.
LINE_RATIO = 0.05
LINE_WORDS = 3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or score low as trusted text go."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many documents of a source go; a document keeps its row and its other lines."""
    cut = lines.without_boilerplate(docs, F.col("source"), F.col("text"), max_ratio=LINE_RATIO, min_words=LINE_WORDS)
    change = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*[change.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's text becomes the words that the mix takes of it, repeats included."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequences and places."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]

# Hashed n-grams, fingerprints and token ids are beyond SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
