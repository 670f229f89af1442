"""Continuous synchronisation: a stream of log files folded into items and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tanadex.model import LOG_SCHEMA
from tanadex.operators import changes
from tanadex.operators.extract import extract_records, explode_items, log_rows
from tanadex.streaming.store import ItemStore


def stream_log(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LOG_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _start(stream: DataFrame, apply, checkpoint: str, once: bool, interval: str) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def sync_items(log: DataFrame, store: ItemStore, checkpoint: str, once: bool = True,
               interval: str = "60 seconds", skew: changes.Skew = changes.Skew()) -> StreamingQuery:
    """Keep the store up to date with a log stream; offsets live in the checkpoint."""
    return _start(log, lambda rows, batch: store.apply(rows, batch, skew), checkpoint, once, interval)


def sync_once(log: DataFrame, store: ItemStore, max_records: int | None = None,
              skew: changes.Skew = changes.Skew()) -> None:
    """Batch form: apply what lies past the cursor, oldest first."""
    version = store.version()
    rows = changes.pending_log(log, store.cursor(version), max_records)
    store.apply(rows, 0 if version is None else version + 1, skew, after_cursor=True)


def extract_to_log(pages: DataFrame, profiles, log_path: str, checkpoint: str, once: bool = True,
                   interval: str = "60 seconds", run_id: int = -1) -> StreamingQuery:
    """Pages to log rows. Ids continue after the rows of earlier batches.

    Each batch writes its own folder, so a repeated batch replaces its rows.
    """
    def apply(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        last = _last_log_id(spark, log_path, batch)
        items = explode_items(extract_records(rows, profiles))
        found = log_rows(items, F.current_timestamp(), run_id, last)
        found.write.mode("overwrite").parquet(f"{log_path}/batch={batch}")

    return _start(pages, apply, checkpoint, once, interval)


def _last_log_id(spark: SparkSession, path: str, batch: int) -> int:
    """Largest id of the batches before: ids rise from batch to batch, so the last one with rows has it."""
    for before in range(batch - 1, -1, -1):
        last = spark.read.schema("log_id long, batch int").parquet(path).where(F.col("batch") == before).agg(F.max("log_id")).first()[0]
        if last is not None:
            return last
    return 0
