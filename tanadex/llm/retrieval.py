"""Exact top-k inner products: vectors in buckets of like length, pruned by length or by one coordinate, then verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanadex.llm.common import saved

TOP = 5
SCALE = 256
EVERY = 50
# Lengths of a bucket lie within a factor 2^(1/4); a bucket is cut into blocks of so many vectors.
LEVELS = 4
BLOCK = 8192
QUERY_BLOCK = 2048
# Blocks of the longest vectors that give each query its first threshold.
FIRST_BLOCKS = 2
SLACK = 1e-9
PACKED = "dim int, level int, block long, rids binary, ids binary, rows binary, longest double, theta binary"


def integer_vectors(table: DataFrame) -> DataFrame:
    """(rid, vec_id, v, dim, norm) of the rows that take part: floor(256 x) of every component, as whole numbers."""
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double"))
    rows = table.where(usable).select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("dim", F.size("v")).withColumn("norm", norm)


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("norm", ascending=False, kind="stable")
    theta = frame["theta"].to_numpy() if "theta" in frame else np.zeros(0)
    return pd.DataFrame({
        "dim": frame["dim"].iloc[:1], "level": frame["level"].iloc[:1], "block": frame["block"].iloc[:1],
        "rids": [frame["rid"].to_numpy(np.int64).tobytes()], "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()],
        "rows": [np.array(frame["v"].tolist(), np.float64).tobytes()], "longest": [float(frame["norm"].max())],
        "theta": [theta.astype(np.float64).tobytes()]})


def packed(vectors: DataFrame, level: Column, size: int) -> DataFrame:
    """One row for each block of vectors of one dimension and level; equal vectors spread over a level's blocks."""
    levelled = vectors.withColumn("level", level)
    # One row for each dimension and level of length: a few hundred at most, whatever the number of vectors.
    counts = levelled.groupBy("dim", "level").agg(F.count(F.lit(1)).alias("n"))
    dealt = levelled.join(counts, ["dim", "level"]).withColumn(
        "block", F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / size))).drop("n")
    return dealt.groupBy("dim", "level", "block").applyInPandas(_pack, PACKED)


class Block:
    """A block of vectors, longest first, with each coordinate of the unit vectors in order."""

    def __init__(self, rids: bytes, ids: bytes, rows: bytes, dim: int):
        self.rids, self.ids = np.frombuffer(rids, np.int64), np.frombuffer(ids, np.int64)
        self.rows = np.frombuffer(rows, np.float64).reshape(len(self.ids), dim)
        self.norm = np.sqrt((self.rows ** 2).sum(axis=1))
        self.unit = np.divide(self.rows, self.norm[:, None], out=np.zeros_like(self.rows), where=self.norm[:, None] > 0)
        self.order: dict[int, np.ndarray] = {}

    def candidates(self, q: np.ndarray, length: float, theta: float) -> np.ndarray | slice:
        """Rows that can reach ``theta``: those long enough, or those whose coordinate at the query's largest lies in
        the feasible region of the block's cosine threshold, whichever are fewer."""
        every = slice(None)
        if not len(self.ids) or not np.isfinite(theta) or length == 0:
            return every
        bound = self.norm[0] if theta > 0 else self.norm[-1]
        if bound == 0:
            return every if theta <= 0 else np.zeros(0, np.int64)
        cosine = theta / (length * bound) - SLACK
        if cosine > 1:
            return np.zeros(0, np.int64)
        enough = np.searchsorted(-self.norm, -(theta / length * (1 - SLACK)), "right") if theta > 0 else len(self.norm)
        if cosine <= -1:
            return slice(0, enough)
        f = int(np.abs(q).argmax())
        if f not in self.order:
            self.order[f] = np.argsort(self.unit[:, f], kind="stable")
        line = self.unit[self.order[f], f]
        own, wide = np.arccos(np.clip(q[f] / length, -1, 1)), np.arccos(cosine)
        low, high = np.cos(min(np.pi, own + wide)) - SLACK, np.cos(max(0.0, own - wide)) + SLACK
        a, b = np.searchsorted(line, low, "left"), np.searchsorted(line, high, "right")
        return slice(0, enough) if enough <= b - a else self.order[f][a:b]


def _best(block: Block, queries: Block, theta: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    for k, q in enumerate(queries.rows):
        chosen = block.candidates(q, queries.norm[k], theta[k] if len(theta) else -np.inf)
        score, ids, rids = block.rows[chosen] @ q, block.ids[chosen], block.rids[chosen]
        fit = rids != queries.rids[k]
        score, ids = score[fit], ids[fit]
        if len(score) > TOP:
            near = score >= np.partition(score, -TOP)[-TOP]
            score, ids = score[near], ids[near]
        for i in np.lexsort((ids, -score))[:TOP]:
            yield int(queries.rids[k]), int(queries.ids[k]), int(ids[i]), int(score[i])


def _search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for r in frame.itertuples(index=False):
            found = list(_best(Block(r.rids, r.ids, r.rows, r.dim), Block(r.q_rids, r.q_ids, r.q_rows, r.dim),
                               np.frombuffer(r.q_theta, np.float64)))
            yield pd.DataFrame(found, columns=["q_rid", "query_id", "vec_id", "score"]).astype("int64")


def _hits(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """The best of each block for each query. Pairs of blocks meet by their own key, one pair to a group of its own."""
    keys = blocks.select("dim", "level", "block", "longest")
    asked = queries.select("dim", F.col("block").alias("q_block"), F.col("least").alias("least"))
    # Both sides hold one row for a block of thousands. A pair is left out if no query reaches its threshold there.
    pairs = keys.join(asked, "dim").where("longest >= least").drop("longest", "least")
    left = pairs.join(blocks.drop("longest", "theta"), ["dim", "level", "block"])
    right = queries.select("dim", F.col("block").alias("q_block"), F.col("rids").alias("q_rids"), F.col("ids").alias("q_ids"),
                           F.col("rows").alias("q_rows"), F.col("theta").alias("q_theta"))
    return left.join(right, ["dim", "q_block"]).repartition("level", "block", "q_block").mapInPandas(
        _search, "q_rid long, query_id long, vec_id long, score long")


def _ranked(hits: DataFrame) -> DataFrame:
    order = W.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def _query_blocks(rows: DataFrame) -> DataFrame:
    def least(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for theta, rows, dim in zip(f["theta"], f["rows"], f["dim"]):
                t, q = np.frombuffer(theta, np.float64), np.frombuffer(rows, np.float64).reshape(-1, dim) if dim else None
                length = np.sqrt((q ** 2).sum(axis=1)) if dim else np.zeros(len(t))
                need = np.where((t > 0) & (length > 0), t / np.maximum(length, 1) * (1 - SLACK), 0)
                out.append(float(need.min(initial=np.inf)))
            yield f.assign(least=out)
    return packed(rows, F.lit(0), QUERY_BLOCK).mapInPandas(least, PACKED + ", least double")


def top_products(table: DataFrame, is_query: Column) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``TOP`` highest inner products with all other rows.

    ``table`` has vec_id and embedding. Rows with a null id, a null vector, or a null or non-finite component take no
    part; vectors meet those of their own dimension. Ties go to the smaller vec_id; repeated rows are rows of their
    own; a query with fewer partners gets all; an empty table gives no rows. A first pass over the longest vectors
    gives each query a threshold no higher than its final one, so pruning by it loses nothing, ties included.
    """
    vectors = saved(integer_vectors(table))
    level = F.when(F.col("norm") > 0, F.floor(LEVELS * F.log2("norm"))).otherwise(-1).cast("int")
    blocks = saved(packed(vectors, level, BLOCK))
    asked = vectors.where(is_query)
    place = W.partitionBy("dim").orderBy(F.desc("level"), "block")
    first = (blocks.select("dim", "level", "block").withColumn("k", F.row_number().over(place))
             .where(F.col("k") <= FIRST_BLOCKS).drop("k"))
    start = _hits(blocks.join(first, ["dim", "level", "block"], "left_semi"),
                  _query_blocks(asked.withColumn("theta", F.lit(float("-inf")))))
    theta = _ranked(start).where(F.col("rank") == TOP).select(F.col("q_rid").alias("rid"), F.col("score").cast("double")
                                                             .alias("theta"))
    bounded = asked.join(theta, "rid", "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))))
    return _ranked(_hits(blocks, saved(_query_blocks(bounded)))).select("query_id", "rank", "vec_id", "score")
