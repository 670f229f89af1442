"""Helpers for data of any size: stored steps and dense numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window as W, functions as F

# Log ids to a piece of one item's history.
CHUNK_ROWS = 1 << 20
# Bounds between which a key is looked up in one step; its square is the number of ranges.
STEP = 16
# Rows of a compact table that one task works on.
TASK_ROWS = 1 << 15


def dealt(rows: DataFrame, key: str, task_rows: int | None = None) -> DataFrame:
    """Rows dealt by a key, as many to a task at any size: for costly work on rows that are so compact when stored that a
    reader, which counts bytes, gives very many of them to one task."""
    return rows.repartition(rows.count() // (task_rows or TASK_ROWS) + 1, key)


def _shared_folder(spark) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session may go without."""
    context = spark.sparkContext
    folder = (spark.conf.get("spark.checkpoint.dir", None)
              or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir())
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-tanadex-", dir="/tmp")
        context.setCheckpointDir(folder)
    return folder


def shared_path(spark) -> str:
    """A new path below the shared folder."""
    return f"{_shared_folder(spark).rstrip('/')}/tanadex/{uuid.uuid4().hex}"


def saved(rows: DataFrame) -> DataFrame:
    """Write rows once as a table in the shared folder and go on from that table.

    For results that several later steps read: they are not computed again, their
    size is known to the planner, and a lost executor loses nothing.
    """
    spark = rows.sparkSession
    path = shared_path(spark)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def dense_number(rows: DataFrame, key: str, *order: str, name: str, start=1,
                 span: int = 1 << 20) -> DataFrame:
    """Number rows 1, 2, 3 … by a long ``key`` (then ``order``) without one global sort.

    Rows are cut into ranges of ``span`` key values. Only the row count of each range
    passes through a single window; rows are numbered within their range. Rows without a
    key come first, in ``order``.
    """
    cut = rows.withColumn("_range", F.coalesce(F.floor(F.col(key) / F.lit(span)).cast("bigint"), F.lit(-(1 << 63))))
    counts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_range").orderBy(key, *order)
    start = F.lit(start) if isinstance(start, int) else start
    return (cut.withColumn("_pos", F.row_number().over(inside))
            .join(offsets, "_range")
            .withColumn(name, (F.col("_offset") + F.col("_pos") - 1 + start).cast("bigint"))
            .drop("_range", "_offset", "_pos"))


def quantile_number(rows: DataFrame, key: str, *order: str, name: str, start=1) -> DataFrame:
    """As ``dense_number``, for keys that lie anywhere: ranges hold about as many rows each, however sparse the keys.

    The bounds are quantiles of the key, found in one pass of mergeable summaries. A row looks its range up in two
    steps, among every ``STEP``-th bound and among those between two of them. ``rows`` are read three times, so they should be stored.
    """
    def cuts(n):
        return F.percentile_approx(key, [k / n for k in range(1, n)], 10_000)
    both = rows.agg(F.struct(cuts(STEP).alias("coarse"), cuts(STEP * STEP).alias("fine")).alias("b")).scalar()
    value = F.col(key)
    near = rows.withColumn("_b", both).withColumn("_c", F.size(F.filter("_b.coarse", lambda b: b <= value)))
    within = F.slice("_b.fine", F.col("_c") * STEP + 1, F.lit(STEP - 1))
    place = F.when(value.isNull(), F.lit(-1)).otherwise(F.col("_c") * STEP + F.size(F.filter(within, lambda b: b <= value)))
    cut = near.withColumn("_range", place).drop("_b", "_c")
    counts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # no more than STEP * STEP + 1 rows
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_range").orderBy(key, *order)
    start = F.lit(start) if isinstance(start, int) else start
    return (cut.withColumn("_pos", F.row_number().over(inside)).join(offsets, "_range")
            .withColumn(name, (F.col("_offset") + F.col("_pos") - 1 + start).cast("bigint"))
            .drop("_range", "_offset", "_pos"))
