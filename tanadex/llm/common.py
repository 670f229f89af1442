"""Words, intermediate tables and row wrapping shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The white space that parts words, as a class and as characters.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a one-process session without it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-llm-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def saved(rows: DataFrame) -> DataFrame:
    """Write rows once below the shared folder and go on from the files; a lost executor loses none of them."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    bare = F.trim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def wrapped(rows: DataFrame, **more: Column) -> DataFrame:
    """All columns inside one struct ``row``, so that no name among them can clash with working columns."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
                       *[c.alias(name) for name, c in more.items()])
