"""Hard negatives by slots: the limits of an anchor's positives part its scores, and suffixes of slots answer windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanadex.llm.common import saved

POSITIVES = 5
NEGATIVES = 5
SCALE = 256
EVERY = 100
# A negative's score, times HIGH, lies between LOW and HIGH times the positive's.
LOW, HIGH = 80, 100
# Components in a block of vectors or anchors; scores computed at a time.
VECTOR_VALUES = 1 << 19
ANCHOR_VALUES = 1 << 16
SCORES = 1 << 21
# Labels fall into so many parts, so that an anchor meets a fraction of the other labels when it looks for its own.
LABEL_PARTS = 64
EXACT = float(1 << 53)
LONGS = (-(1 << 63), (1 << 63) - 1)

BLOCK = "dim int, part int, block int, rids binary, ids binary, labels binary, rows binary"
HITS = "rid long, slot int, hit_rid long, vec_id long, score long"
KEY = ["dim", "part", "a_block", "v_block"]


def labelled_vectors(table: DataFrame, label: Column) -> DataFrame:
    """(rid, vec_id, label, dim, v) of the rows that take part; ``v`` holds the components as doubles."""
    usable = F.forall("embedding", lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double") * F.lit(float(SCALE))) < float("inf")), F.lit(False)))
    rows = table.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & label.isNotNull() & usable)
    return rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"),
                       label.cast("long").alias("label"), F.size("embedding").alias("dim"),
                       F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    rows = np.floor(np.array(frame["v"].tolist(), np.float64) * SCALE)
    packed = frame.iloc[:1][["dim", "part", "block"]].assign(
        rids=[frame["rid"].to_numpy(np.int64).tobytes()], ids=[frame["vec_id"].to_numpy(np.int64).tobytes()],
        labels=[frame["label"].to_numpy(np.int64).tobytes()], rows=[rows.tobytes()])
    if "limits" in frame:
        limits = [np.asarray(x, np.int64) for x in frame["limits"]]
        packed = packed.assign(lows=[frame["low"].to_numpy(np.int64).tobytes()], limits=[np.concatenate(limits).tobytes()],
                               n_limits=[np.array([len(x) for x in limits], np.int64).tobytes()])
    return packed


def packed(rows: DataFrame, part: Column, blocks: int) -> DataFrame:
    """One row for each block; equal vectors and frequent labels spread over all blocks."""
    more = ", lows binary, limits binary, n_limits binary" if "limits" in rows.columns else ""
    dealt = rows.withColumn("part", part.cast("int")).withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "part", "block").applyInPandas(_pack, BLOCK + more)


def _unpacked(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rids = np.frombuffer(r.rids, np.int64)
    return (rids, np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64),
            np.frombuffer(r.rows, np.float64).reshape(len(rids), int(r.dim)))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact; those beyond 64 bits stand at the limit of long."""
    longest = [np.sqrt((x ** 2).sum(axis=1)).max(initial=0.0) for x in (left, right)]
    if longest[0] * longest[1] < EXACT / 2:
        return (left @ right.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in side], object).reshape(side.shape) for side in (left, right)]
    return np.clip(whole[0] @ whole[1].T, *LONGS).astype(np.int64)


def first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id, in that order."""
    near = np.arange(len(score))
    if len(score) > k:
        near = np.flatnonzero(score >= np.partition(score, -k)[-k])
    return near[np.lexsort((ids[near], -score[near]))][:k]


def _scored(anchors: pd.DataFrame, vectors: pd.DataFrame) -> Iterator[tuple]:
    """(anchor block, place, vector block, scores of that anchor), anchor after anchor."""
    for a in anchors.itertuples(index=False):
        own = _unpacked(a)
        for b in vectors.itertuples(index=False):
            other = _unpacked(b)
            step = max(1, SCORES // max(1, len(other[0])))
            for at in range(0, len(own[0]), step):
                for k, score in enumerate(products(own[3][at:at + step], other[3]), at):
                    yield a, own, k, other, score


def _hits(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["rid", "slot", "hit_rid", "vec_id", "score"]).astype(
        {"rid": "int64", "slot": "int32", "hit_rid": "int64", "vec_id": "int64", "score": "int64"})


def _own_label(anchors: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
    found = []
    for _, (rids, _, labels, _), k, (o_rids, o_ids, o_labels, _), score in _scored(anchors, vectors):
        fit = np.flatnonzero((o_labels == labels[k]) & (o_rids != rids[k]))
        fit = fit[first(score[fit], o_ids[fit], POSITIVES)]
        found += [(rids[k], 0, *hit) for hit in zip(o_rids[fit], o_ids[fit], score[fit])]
    return _hits(found)


def _by_slot(anchors: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
    """The first of each slot. Limits fall; slot j holds the scores above limit j + 1, up to limit j."""
    found, block = [], None
    for a, (rids, _, labels, _), k, (o_rids, o_ids, o_labels, _), score in _scored(anchors, vectors):
        if a is not block:
            block, all_lows = a, np.frombuffer(a.lows, np.int64)
            ends = np.cumsum(np.frombuffer(a.n_limits, np.int64))
            all_limits = np.split(np.frombuffer(a.limits, np.int64), ends[:-1])
        limits = all_limits[k]
        fit = np.flatnonzero((o_labels != labels[k]) & (score <= limits[0]) & (score >= all_lows[k]))
        slots = len(limits) - np.searchsorted(limits[::-1], score[fit], "left") - 1
        for slot in np.unique(slots):
            own = fit[slots == slot]
            own = own[first(score[own], o_ids[own], NEGATIVES)]
            found += [(rids[k], slot, *hit) for hit in zip(o_rids[own], o_ids[own], score[own])]
    return _hits(found)


def _met(anchors: DataFrame, a_blocks: int, vectors: DataFrame, v_blocks: int, task) -> DataFrame:
    """Every anchor block meets every vector block of its dimension and part, each pair a group of its own."""
    left = anchors.withColumn("a_block", F.col("block")).withColumn("v_block", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))
    right = vectors.withColumn("v_block", F.col("block")).withColumn("a_block", F.explode(F.sequence(F.lit(0), F.lit(a_blocks - 1))))
    return left.groupBy(*KEY).cogroup(right.groupBy(*KEY)).applyInPandas(task, HITS)


def _kept(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("rid", "slot").orderBy(F.desc("score"), "vec_id", "hit_rid")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(table: DataFrame, is_anchor: Column, label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of a table (vec_id, embedding, label).

    An anchor's positives are its ``POSITIVES`` best other rows of its label. For each, the ``NEGATIVES`` best rows of
    other labels whose scores lie between ``LOW`` and ``HIGH`` hundredths of the positive's. The distinct positive
    scores of an anchor part its scores into slots; every block of vectors keeps the best of each slot, and so do the
    steps that combine them. The best below a limit are the best of the slots from there on: one merge from the lowest
    slot upwards gives every suffix, and the lower limit of a window cuts its suffix short.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors meet those of their
    own dimension. Ties go to the smaller vec_id. Repeated rows are rows of their own, others to each other. An anchor
    without positives, or a positive without negatives in its window, has no rows; nor has an empty table. Further
    columns are not looked at. Scores beyond 64 bits stand at the limit of long.
    """
    vectors = saved(labelled_vectors(table, F.col("label") if label is None else label))
    asked = vectors.where(is_anchor)
    size = vectors.agg(F.sum(F.greatest("dim", F.lit(1))).alias("all"),
                       F.sum(F.when(is_anchor, F.greatest("dim", F.lit(1)))).alias("asked")).first()
    v_blocks, a_blocks = -(-(size["all"] or 1) // VECTOR_VALUES), -(-(size["asked"] or 1) // ANCHOR_VALUES)
    part = F.pmod(F.xxhash64("label"), F.lit(LABEL_PARTS))
    near = _met(packed(asked, part, a_blocks), a_blocks, packed(vectors, part, v_blocks), v_blocks, _own_label)
    low = -F.floor(-F.col("score").cast("decimal(20,0)") * LOW / HIGH).cast("long")
    positive = F.struct("place", "score", F.col("vec_id").alias("positive_id"), low.alias("low"))
    positives = saved(_kept(near, POSITIVES).groupBy("rid").agg(F.sort_array(F.collect_list(positive)).alias("positives")))
    limits = F.reverse(F.array_sort(F.array_distinct(F.col("positives.score"))))
    anchors = asked.join(positives.select("rid", limits.alias("limits"), F.array_min("positives.low").alias("low")), "rid")
    met = _met(packed(anchors, F.lit(0), a_blocks), a_blocks, packed(vectors, F.lit(0), v_blocks), v_blocks, _by_slot)
    hit = F.struct(F.col("slot").alias("slot"), F.col("place").alias("place"), "score", "vec_id")
    best = _kept(met, NEGATIVES).groupBy("rid").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    merged = F.reduce(
        F.reverse(F.sequence(F.lit(0), F.size("limits") - 1)), F.slice(F.array("hits"), 1, 0),
        lambda done, slot: F.concat(F.array(F.slice(F.concat(
            F.filter("hits", lambda h: h["slot"] == slot), F.coalesce(F.get(done, F.lit(0)), F.slice("hits", 1, 0))),
            1, NEGATIVES)), done))
    windows = (best.join(positives, "rid").withColumn("limits", limits).withColumn("suffixes", merged)
               .select("rid", "limits", "suffixes", F.explode("positives").alias("p")))
    suffix = F.element_at("suffixes", F.array_position("limits", F.col("p.score")).cast("int"))
    inside = F.filter(suffix, lambda h: h["score"] >= F.col("p.low"))
    rows = windows.select("rid", "p", F.posexplode(inside).alias("k", "h"))
    return rows.join(asked.select("rid", F.col("vec_id").alias("anchor_id")), "rid").select(
        "anchor_id", F.col("p.positive_id").alias("positive_id"), (F.col("k") + 1).alias("rank"),
        F.col("h.vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"),
        F.col("h.score").alias("negative_score"))
