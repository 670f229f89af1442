"""Near-duplicates by SimHash: pigeonring candidates, Hamming links, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tanadex.llm.common import saved
from tanadex.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
# Segments of eight bits on the ring.
SEGMENTS = 8
# A bucket with more fingerprints is split further; nothing is left out of it.
BUCKET_ROWS = 2048
# Free bits of a bucket at each split. At the last, 2^12 different fingerprints are the most a bucket can hold.
SPLIT_WIDTHS = (32, 24, 18, 15)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingle hashes of a text, as an unsigned number."""
    words = (text or b"").lower().split()  # bytes: only A-Z are lowered, only ASCII white space parts words
    if not words:
        return 0
    span = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = len(words) - span + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, last, 1 << 16):
        to = min(last, at + (1 << 16))
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in
                           zip(starts[at:to].tolist(), ends[at + span - 1:to + span - 1].tolist())])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > last).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, fp long"))


def _turned(fp: Column, start: int) -> Column:
    """Bits of a fingerprint, with segment ``start`` first."""
    shift = 64 // SEGMENTS * start
    return fp if not shift else F.shiftleft(fp, shift).bitwiseOR(F.shiftrightunsigned(fp, 64 - shift))


def _bits(value: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << n) - 1))


def ring_keys(prints: DataFrame) -> DataFrame:
    """Bucket keys under which two fingerprints of at most three differing bits must meet.

    Eight segments on a ring, three differences: some chain of segments has at most floor(3 l / 8) differences in its
    first l segments for every l. So its first two segments are equal, and its first five differ in one bit at most,
    which lies in one of the segments three to five: leave out each of these in turn, and the other four segments
    (32 bits) are equal. 24 keys a fingerprint; ``rest`` holds the 32 bits outside the key.
    """
    found = []
    for start in range(SEGMENTS):
        turned = _turned(F.col("fp"), start)
        for out in (2, 3, 4):
            left = [_bits(turned, 56 - 8 * s, 8) for s in (2, 3, 4) if s != out]
            key = F.shiftleft(_bits(turned, 48, 16), 16).bitwiseOR(F.shiftleft(left[0], 8)).bitwiseOR(left[1])
            rest = F.shiftleft(_bits(turned, 56 - 8 * out, 8), 24).bitwiseOR(_bits(turned, 0, 24))
            found.append(F.struct(F.lit(start).cast("int").alias("start"), (key + F.lit((3 * start + out) << 32)).alias("key"),
                                  rest.alias("rest")))
    return prints.select("fp", F.explode(F.array(*found)).alias("k")).select("fp", "k.*")


def _split(rows: DataFrame, width: int) -> DataFrame:
    """Buckets split by four parts of their free bits: three differences leave one part equal."""
    n = -(-width // 4)
    parts = []
    for k in range(4):
        low = F.col("rest").bitwiseAND(F.lit((1 << (k * n)) - 1))
        high = F.shiftleft(F.shiftrightunsigned("rest", (k + 1) * n), k * n)
        parts.append(F.struct(F.xxhash64("key", F.lit(k), _bits(F.col("rest"), k * n, n)).alias("key"),
                              low.bitwiseOR(high).alias("rest")))
    return rows.select("fp", "start", F.explode(F.array(*parts)).alias("k")).select("fp", "start", "k.*")


def _join_trees(tree: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        x, y = tree[a], tree[b]
        if not (apart := x != y).any():
            return tree
        np.minimum.at(tree, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while ((up := tree[tree]) != tree).any():
            tree = up


def link_buckets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links inside each bucket of rows sorted by key: a spanning forest of the links, not all of them.

    Pairs are compared along growing distance in the sorted rows. The cumulative budgets of the chain prune a pair
    before its last segments are looked at; pairs whose ends already hang together are skipped.
    """
    held = None
    for frame in frames:
        frame = pd.concat([held, frame], ignore_index=True) if held is not None else frame
        last = frame["key"].to_numpy() == frame["key"].iat[-1] if len(frame) else np.zeros(0, bool)
        held, done = frame[last], frame[~last]
        yield _linked(done)
    if held is not None:
        yield _linked(held)


def _linked(frame: pd.DataFrame) -> pd.DataFrame:
    key, fp = frame["key"].to_numpy(), frame["fp"].to_numpy()
    bits, shift = fp.view(np.uint64), (8 * frame["start"].to_numpy()).astype(np.uint64)
    turned = np.where(shift == 0, bits, (bits << shift) | (bits >> ((np.uint64(64) - shift) & np.uint64(63))))
    tree, alive, step = np.arange(len(key)), np.arange(len(key)), 1
    while len(alive := alive[alive + step < len(key)]) and len(alive := alive[key[alive] == key[alive + step]]):
        pairs = alive[tree[alive] != tree[alive + step]]
        for length in range(3, SEGMENTS + 1):
            differ = np.bitwise_count((turned[pairs] ^ turned[pairs + step]) >> np.uint64(64 - 8 * length))
            pairs = pairs[differ <= MAX_BITS * length // SEGMENTS]
        if len(pairs):
            tree = _join_trees(tree, pairs, pairs + step)
        step += 1
    leaf = np.flatnonzero(tree != np.arange(len(key)))
    return pd.DataFrame({"a": fp[leaf], "b": fp[tree[leaf]]})


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints with ``MAX_BITS`` or fewer differing bits as their full graph does."""
    rows, found = saved(ring_keys(prints.select("fp").distinct())), []
    for width in (*SPLIT_WIDTHS, None):
        large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET_ROWS).select("key")
        large = saved(large) if width else None
        hot = width and not large.isEmpty()
        near = rows.join(large, "key", "left_anti") if hot else rows
        found.append(near.repartition("key").sortWithinPartitions("key", "fp")
                     .mapInPandas(link_buckets, "a long, b long"))
        if not hot:
            break
        rows = saved(_split(rows.join(large, "key", "left_semi"), width))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text); other columns are not looked at.

    component_id is the smallest doc_id reachable over links of ``MAX_BITS`` or fewer differing bits. Null, empty
    and blank texts have fingerprint zero and are linked like any other; a null doc_id keeps its row and names no
    component, unless all of its component are null, which then have a null component_id. Repeated rows and ties
    share a fingerprint and so a component; an empty table gives no rows. Copies meet as one fingerprint before any
    comparison.
    """
    prints = saved(fingerprints(docs, shingle))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    tied = saved(components(links(prints)))
    named = first.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The documents without near-duplicates: of each component the row of its smallest doc_id stays, once.

    Rows with a null doc_id cannot be told apart and stay as they are.
    """
    stay = (near_duplicates(docs, shingle).where("doc_id = component_id").select("doc_id").distinct())
    named = docs.where(F.col("doc_id").isNotNull()).join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
