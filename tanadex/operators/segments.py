"""A search index of segments: appended, never changed in place; compacted when there are many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tanadex.operators import search
from tanadex.operators.scale import shared_path

# Pieces of a segment's postings by term: a lookup of few terms reads the pieces that can hold them.
PIECES = 16
POSTINGS = "field string, term string, id long, tf long, doc_len long, leads boolean, piece int"


def piece_of(term) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PIECES)).cast("int")


class SegmentedIndex:
    """Documents and postings in numbered segments below one folder, with tombstones for what later segments replace.

    An upsert appends a segment: the documents, their postings and term counts, and a tombstone for each id, which hides
    the id in earlier segments. A deletion appends tombstones only. Stored files are never changed, so the bytes of an
    upsert follow its documents. ``live`` lists the segments; it is written last and names a whole index, so a lost
    write leaves the index before it. ``compact`` writes the living rows as one segment.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or shared_path(spark)).rstrip("/")
        self.live: list[int] = []
        self.step = 0

    def _at(self, segment: int, name: str) -> str:
        return f"{self.path}/seg={segment}/{name}"

    def _commit(self, live: list[int]) -> SegmentedIndex:
        rows = self.spark.createDataFrame([(s,) for s in live], "segment int")
        rows.coalesce(1).write.parquet(f"{self.path}/live/step={self.step + 1}")
        self.live, self.step = live, self.step + 1
        return self

    def open(self, step: int) -> SegmentedIndex:
        """The index as of a step."""
        self.live = sorted(r[0] for r in self.spark.read.parquet(f"{self.path}/live/step={step}").collect())
        self.step = step
        return self

    # ---- writing ---------------------------------------------------------------------

    def _segment(self, docs: DataFrame, ids: DataFrame) -> int:
        number = self.step
        ids.select("id").distinct().write.mode("overwrite").parquet(self._at(number, "tombs"))
        docs.write.mode("overwrite").parquet(self._at(number, "docs"))
        stored = self.spark.read.schema(docs.schema).parquet(self._at(number, "docs"))
        rows = search.postings(stored).withColumn("piece", piece_of("term"))
        (rows.hint("rebalance", "piece").write.mode("overwrite").partitionBy("piece").parquet(self._at(number, "postings")))
        counts = self._part(number, "postings").groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
        counts.write.mode("overwrite").parquet(self._at(number, "terms"))
        return number

    def upsert(self, docs: DataFrame) -> SegmentedIndex:
        """Put documents in, each id's earlier ones replaced; an id stands once in ``docs``."""
        return self._commit([*self.live, self._segment(docs, docs)])

    def delete(self, ids: DataFrame) -> SegmentedIndex:
        """Take documents out."""
        empty = self.docs().limit(0) if self.live else None
        return self if empty is None else self._commit([*self.live, self._segment(empty, ids)])

    def compact(self) -> SegmentedIndex:
        """One segment of what is alive."""
        docs = self.docs()
        return self._commit([self._segment(docs, docs)])

    # ---- reading ---------------------------------------------------------------------

    def _part(self, segment: int, name: str) -> DataFrame:
        reader = self.spark.read.schema(POSTINGS) if name == "postings" else self.spark.read  # may have no piece at all
        return reader.parquet(self._at(segment, name))

    def _read(self, name: str) -> DataFrame:
        parts = [self._part(s, name).withColumn("segment", F.lit(s)) for s in self.live]
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.unionByName(more)
        return whole

    def hidden(self) -> DataFrame:
        """(id, until): ids with a tombstone, and the last segment that has one; earlier segments do not show the id."""
        later = [self.spark.read.parquet(self._at(s, "tombs")).withColumn("until", F.lit(s)) for s in self.live[1:]]
        if not later:
            return self.spark.read.parquet(self._at(self.live[0], "tombs")).limit(0).withColumn("until", F.lit(0))
        whole = later[0]
        for more in later[1:]:
            whole = whole.unionByName(more)
        return whole.groupBy("id").agg(F.max("until").alias("until"))

    def _alive(self, rows: DataFrame) -> DataFrame:
        if len(self.live) == 1:
            return rows.drop("segment")
        marked = rows.join(self.hidden(), "id", "left")
        return marked.where(F.col("until").isNull() | (F.col("until") <= F.col("segment"))).drop("until", "segment")

    def docs(self) -> DataFrame:
        return self._alive(self._read("docs"))

    def postings(self) -> DataFrame:
        return self._alive(self._read("postings").drop("piece"))

    def lookup(self, terms: list[str]) -> DataFrame:
        """Living postings of some terms, from the pieces that can hold them."""
        wanted = F.array(*map(F.lit, terms))
        pieces = [r[0] for r in self.spark.range(1).select(F.explode(F.transform(wanted, piece_of)).alias("p")).distinct().collect()]
        rows = self._read("postings").where(F.col("piece").isin(pieces) & F.col("term").isin(terms))
        return self._alive(rows.drop("piece"))

    def vocabulary(self) -> DataFrame:
        """Document frequency of each living term per field: the stored counts of all segments, less the hidden postings."""
        stored = self._read("terms").select("field", "term", "df")
        if len(self.live) > 1:
            gone = self._read("postings").join(self.hidden(), "id").where(F.col("segment") < F.col("until"))
            stored = stored.unionByName(gone.groupBy("field", "term").agg((-F.count(F.lit(1))).alias("df")))
        return stored.groupBy("field", "term").agg(F.sum("df").alias("df")).where(F.col("df") > 0)

    def field_stats(self) -> DataFrame:
        return search.field_stats(self.postings())
