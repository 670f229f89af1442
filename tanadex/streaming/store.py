"""Items kept in hash buckets: a batch rewrites the buckets it touches, and one small write makes it visible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tanadex.operators import changes

BUCKETS = 64
# Versions that stay readable: the newest, and the one that a repeated batch starts from.
KEPT = 2


class ItemStore:
    """Item buckets, history, rejected rows, statistics and cursor below one folder.

    Layout: ``items/v=N/bucket=B``, ``history/batch=N``, ``rejects/batch=N``, ``stats/batch=N``, ``changes/v=N`` and
    ``state/v=N``. The state names, for each bucket, the version that holds it. It is written last, so a version is
    complete or not there; a batch that is repeated starts from the version before it and writes the same rows again.
    Buckets that no kept state names are removed, so the store grows with its items, not with its batches.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, kept: int = KEPT):
        self.spark, self.path, self.buckets, self.kept = spark, path.rstrip("/"), buckets, max(KEPT, kept)

    # ---- files -----------------------------------------------------------------------

    def _children(self, name: str, mark: str) -> dict[int, str]:
        """Folders ``mark=N`` below one of the store's folders, by number."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/{name}")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return {}
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        return {int(n.split("=")[1]): f"{self.path}/{name}/{n}" for n in names if n.startswith(f"{mark}=")}

    def _exists(self, path: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _remove(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    # ---- reading ---------------------------------------------------------------------

    def missing_tables(self) -> list[str]:
        """Names of the store's tables that hold nothing yet."""
        return ["items", "history", "state"] if self.version() is None else []

    def version(self, before: int | None = None) -> int | None:
        """The newest complete version, or the newest one below ``before``."""
        done = [v for v, path in self._children("state", "v").items() if self._exists(f"{path}/_SUCCESS")]
        return max((v for v in done if before is None or v < before), default=None)

    def _state(self, version: int | None) -> dict[str, str]:
        """Cursor, largest item id and the version of each bucket: a row each, so many as there are buckets."""
        if version is None:
            return {}
        return {r["key"]: r["value"] for r in self.spark.read.parquet(f"{self.path}/state/v={version}").collect()}

    def cursor(self, version: int | None) -> int:
        """Last log id read; 0 when there is none or it is not a number."""
        value = self._state(version).get("last_log_id") or ""
        return int(value) if value.lstrip("-").isdigit() else 0

    def _buckets(self, state: dict[str, str]) -> dict[int, str]:
        named = {int(k.removeprefix("bucket:")): v for k, v in state.items() if k.startswith("bucket:")}
        return {b: f"{self.path}/items/v={v}/bucket={b}" for b, v in named.items()}

    def items(self, version: int | None = None) -> DataFrame | None:
        version = self.version() if version is None else version
        paths = self._buckets(self._state(version))
        return self.spark.read.parquet(*paths.values()) if paths else None

    def history(self) -> DataFrame:
        """All history rows; one per event key."""
        return self._batches("history")

    def rejects(self) -> DataFrame:
        """Rows that could not be applied, with the reason and their batch."""
        return self._batches("rejects", "batch")

    def stats(self) -> DataFrame:
        """Totals of each batch."""
        return self._batches("stats", "batch")

    def _batches(self, name: str, *more: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{name}").where(F.col("batch") <= self.version())
        return rows if more else rows.drop("batch")

    # ---- writing ---------------------------------------------------------------------

    def apply(self, log: DataFrame, batch: int, skew: changes.Skew = changes.Skew(), after_cursor: bool = False) -> None:
        """Fold one batch of log rows into a new version."""
        previous = self.version(before=batch)
        state = self._state(previous)
        start, top = self.cursor(previous), int(state.get("top_id", 0))
        pending = changes.pending_log(log, start if after_cursor else -1)
        valid = changes.valid_log(pending).withColumn("bucket", F.pmod(F.xxhash64("source_uid"), F.lit(self.buckets)).cast("int"))
        touched = [r[0] for r in valid.select("bucket").distinct().collect()]  # no more than there are buckets
        valid = valid.drop("bucket")
        old = self._buckets(state)
        there = [old[b] for b in touched if b in old]
        # Without a bucket to read, all items of the batch are new; their ids go on from the largest one.
        snapshot = self.spark.read.parquet(*there) if there else None
        known = None
        if previous is not None:  # keys hold the log id, so only rows of these ids can repeat
            oldest = pending.agg(F.min("log_id")).scalar()
            known = (self.spark.read.parquet(f"{self.path}/history")
                     .where((F.col("batch") <= previous) & (F.col("log_id") >= oldest)))
        found = self._written(changes.price_changes(valid, snapshot, skew=skew), f"changes/v={batch}")
        history = self._written(changes.new_history(changes.price_history(found), known), f"history/batch={batch}")
        self._written(changes.rejected_log(pending), f"rejects/batch={batch}")
        self._written(changes.sync_stats(pending, found, history), f"stats/batch={batch}")
        items = changes.current_items(valid, snapshot, skew=skew, top_id=top)
        placed = items.withColumn("bucket", F.pmod(F.xxhash64("source_uid"), F.lit(self.buckets)).cast("int"))
        placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/items/v={batch}")
        if touched:
            new = self.spark.read.parquet(*[f"{self.path}/items/v={batch}/bucket={b}" for b in touched])
            top = max(top, new.agg(F.max("id")).first()[0])
        last = changes.next_cursor(pending, start).select(F.greatest("cursor", F.lit(start))).first()[0]
        rows = {**state, "last_log_id": str(last), "top_id": str(top), **{f"bucket:{b}": str(batch) for b in touched}}
        (self.spark.createDataFrame(sorted(rows.items()), "key string, value string").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/state/v={batch}"))
        self._clean()

    def _written(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def _clean(self) -> None:
        """Remove states beyond the kept ones and the buckets that no kept state names."""
        states = self._children("state", "v")
        kept = sorted(states)[-self.kept:]
        named = reduce(set.union, (set(self._buckets(self._state(v)).values()) for v in kept), set())
        for version, folder in self._children("items", "v").items():
            if version > kept[-1]:
                continue
            held = self._children(f"items/v={version}", "bucket").values()
            for path in held:
                if path not in named:
                    self._remove(path)
            if not named.intersection(held) and version not in kept:
                self._remove(folder)
        for version, path in [*self._children("changes", "v").items(), *states.items()]:
            if version < kept[0]:
                self._remove(path)
