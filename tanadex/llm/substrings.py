"""Substring dedup: fixed-block anchors, probed by every rolling window, extended to maximal exact repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from tanadex.llm.common import SPACE_CHARS, saved

# Words of a repeat, and of an anchor block. A window of 2 * BLOCK words or more holds a whole block of its document.
WINDOW = 20
BLOCK = 10
# Words of a chunk of documents and window hashes of a meeting place, in the mean; both bound a task's arrays.
CHUNK_WORDS = 400_000
PLACE_HASHES = 2_000_000
KEPT_WORDS = 300_000
# Odd multipliers of the rolling hashes.
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
LAST_ID = np.iinfo(np.int64).max
SEPARATORS = [c.encode() for c in SPACE_CHARS]

Batches = Iterator[pa.RecordBatch]


class Hashes(dict):
    """Hash of each word, worked out once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of every run of ``length`` words, from runs of powers of two."""
    out, reach, power, step = None, 0, words, 1
    while True:
        if length & step:
            if out is None:
                out, reach = power, step
            else:
                n = len(words) - reach - step + 1
                shift = np.uint64(pow(base, step, 1 << 64))
                out = out[:max(n, 0)] * shift + power[reach:reach + max(n, 0)]
                reach += step
        if step * 2 > length:
            return mixed(out)
        power = power[:-step] * np.uint64(pow(base, step, 1 << 64)) + power[step:] if len(power) > step else power[:0]
        step *= 2


class Chunk:
    """Documents packed into one compressed value: ids, sizes and texts."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids, self.texts = ids, texts

    def pack(self) -> bytes:
        sizes = np.array([len(t) for t in self.texts], np.int64)
        return zstandard.compress(np.int64(len(sizes)).tobytes() + self.ids.tobytes() + sizes.tobytes() + b"".join(self.texts), 3)

    @classmethod
    def unpack(cls, packed: bytes) -> Chunk:
        data = zstandard.decompress(packed)
        n = int(np.frombuffer(data, np.int64, 1)[0])
        ids, sizes = np.frombuffer(data, np.int64, 2 * n, 8).reshape(2, n)
        at = 8 + 16 * n + np.concatenate(([0], np.cumsum(sizes)))
        return cls(ids, [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())])

    def lay_out(self, memo: Hashes) -> None:
        """Word hashes of all documents in one row, and the document and place of each word."""
        self.words = [t.split() for t in self.texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.sizes)[:-1])) if len(self.sizes) else np.zeros(0, np.int64)
        self.hashes = np.fromiter((memo[w] for words in self.words for w in words), np.uint64, int(self.sizes.sum()))
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(self.doc)) - self.begin[self.doc]

    def starts(self, length: int) -> np.ndarray:
        """Where runs of ``length`` words begin, in documents that hold a whole window."""
        size = self.sizes[self.doc]
        return np.flatnonzero((size >= WINDOW) & (self.place + length <= size))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of every rolling window of an anchor's length."""
        at = self.starts(BLOCK)
        return at, rolled(self.hashes, BLOCK, FIRST)[at] if len(at) else np.zeros(0, np.uint64)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and both hashes of the chosen whole windows, in the order of documents and places."""
        at = self.starts(WINDOW)
        at = at[chosen[at]]
        at = at[np.lexsort((self.place[at], self.doc[at], self.ids[self.doc[at]]))]
        if not len(at):
            return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        other = mixed(self.hashes ^ np.uint64(SECOND))
        return at, rolled(self.hashes, WINDOW, FIRST)[at], rolled(other, WINDOW, SECOND)[at]


def packed(docs: DataFrame) -> DataFrame:
    """(chunk, docs, n): documents in chunks of about ``CHUNK_WORDS`` words, cut as they lie in the input's tasks."""
    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext
        base, made, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def row() -> pa.RecordBatch:
            value = Chunk(np.array([LAST_ID if i is None else i for i in ids], np.int64), texts).pack()
            return pa.RecordBatch.from_arrays(
                [pa.array([base + made]), pa.array([value], pa.binary()), pa.array([size])], ["chunk", "docs", "n"])
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t or b"")
                size += sum(map((t or b"").count, SEPARATORS)) + 1
                if size > CHUNK_WORDS:
                    yield row()
                    made, ids, texts, size = made + 1, [], [], 0
        if ids:
            yield row()
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
            .mapInArrow(run, "chunk long, docs binary, n long"))


def _messages(places: int, chunk: int, key: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each meeting place, with the values of the sorted keys that meet there."""
    place = (key % np.uint64(places)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    cut = np.flatnonzero(np.diff(place[order], prepend=-1))
    bounds = np.append(cut, len(order))
    values = [[c[order[a:b]].tobytes() for a, b in zip(bounds[:-1], bounds[1:])] for c in columns]
    names = ["place", "chunk", *"abcd"[:len(columns)]]
    return pa.RecordBatch.from_arrays([pa.array(place[order][cut], pa.int64()), pa.array([chunk] * len(cut), pa.int64()),
                                       *[pa.array(v, pa.binary()) for v in values]], names)


def _answers(places: int, key: np.ndarray, replies: list[dict]) -> np.ndarray:
    """The bits that came back for the keys of a chunk, in the keys' own order."""
    place = (key % np.uint64(places)).astype(np.int64)
    order, out = np.argsort(place, kind="stable"), np.zeros(len(key), bool)
    n = np.bincount(place, minlength=places)
    at = np.concatenate(([0], np.cumsum(n)))
    for r in replies or ():
        k = r["place"]
        out[order[at[k]:at[k + 1]]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=int(n[k])).astype(bool)
    return out


def _anchor_messages(places: int) -> Callable[[Batches], Batches]:
    """Every distinct rolling window of a chunk, half its hash, and whether it is an anchor or comes twice in the chunk."""
    def run(batches: Batches) -> Batches:
        memo = Hashes()
        for batch in batches:
            for chunk, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = Chunk.unpack(docs)
                c.lay_out(memo)
                at, every = c.anchors()
                key, count = np.unique(every, return_counts=True)
                anchor = np.zeros(len(key), bool)
                anchor[np.searchsorted(key, every[c.place[at] % BLOCK == 0])] = True
                yield _messages(places, chunk, key, [(key >> np.uint64(32)).astype(np.uint32),
                                                     anchor.astype(np.uint8) + 2 * (count > 1).astype(np.uint8)])
    return run


def _meet_anchors(frame: pd.DataFrame) -> pd.DataFrame:
    """A window is a hit if it comes twice or more and an anchor is among its places."""
    sizes = [len(b) for b in frame["b"]]
    half = np.frombuffer(b"".join(frame["a"]), np.uint32)
    flag = np.frombuffer(b"".join(frame["b"]), np.uint8)
    _, inverse, count = np.unique(half, return_inverse=True, return_counts=True)
    anchor = np.bincount(inverse, flag & 1, len(count)) > 0
    twice = (count > 1) | (np.bincount(inverse, flag >> 1, len(count)) > 0)
    return _replied(frame, (anchor & twice)[inverse], sizes)


def _replied(frame: pd.DataFrame, bits: np.ndarray, sizes: list[int]) -> pd.DataFrame:
    parts = np.split(bits, np.cumsum(sizes)[:-1])
    some = [k for k, p in enumerate(parts) if p.any()]
    return pd.DataFrame({"chunk": frame["chunk"].to_numpy()[some], "place": frame["place"].to_numpy()[some],
                         "bits": [np.packbits(parts[k]).tobytes() for k in some]})


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _result(ids: list, words: list, removed: list, digests: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([None if i == LAST_ID else i for i in ids], pa.int64()), pa.array(words, pa.int64()),
         pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _candidates(places: int) -> Callable[[Batches], Batches]:
    """Grow the hits of a chunk to all whole windows around them; documents without any are done."""
    def run(batches: Batches) -> Batches:
        memo = Hashes()
        for batch in batches:
            for chunk, docs, replies in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                c = Chunk.unpack(docs)
                c.lay_out(memo)
                at, every = c.anchors()
                key = np.unique(every)
                hit = np.zeros(len(c.doc) + 1, np.int64)
                if len(key):
                    hit[at] = _answers(places, key, replies)[np.searchsorted(key, every)]
                total = np.concatenate(([0], np.cumsum(hit)))
                begin = np.arange(len(c.doc))
                around = total[np.minimum(begin + WINDOW - BLOCK + 1, len(total) - 1)] > total[begin]
                chosen = np.zeros(len(c.doc), bool)
                whole = c.starts(WINDOW)
                chosen[whole] = around[whole]
                open_docs = np.bincount(c.doc, chosen, len(c.sizes)) > 0
                left = np.flatnonzero(open_docs)
                done = np.flatnonzero(~open_docs)
                rest = Chunk(c.ids[left], [c.texts[k] for k in left])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), pa.array([rest.pack()], pa.binary()),
                     pa.array([np.packbits(chosen[open_docs[c.doc]]).tobytes()], pa.binary()),
                     pa.array([[{"doc_id": None if c.ids[k] == LAST_ID else int(c.ids[k]), "n_words": int(c.sizes[k]),
                                 "kept_sha256": _digest(c.words[k])} for k in done.tolist()]], DONE)],
                    ["chunk", "docs", "chosen", "done"])
    return run


DONE = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string())]))
OPEN = ("chunk long, docs binary, chosen binary, "
        "done array<struct<doc_id: long, n_words: long, kept_sha256: string>>")


def _opened(docs: bytes, chosen: bytes, memo: Hashes) -> tuple:
    """A chunk's open documents, their candidate windows, and of each distinct one its hashes and first place."""
    c = Chunk.unpack(docs)
    c.lay_out(memo)
    at, one, two = c.windows(np.unpackbits(np.frombuffer(chosen, np.uint8), count=len(c.doc)).astype(bool))
    order = np.lexsort((np.arange(len(at)), two, one))
    new = np.ones(len(at), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    group = np.empty(len(at), np.int64)
    group[order] = np.cumsum(new) - 1
    return c, at, one, two, group, order[new]


def _window_messages(places: int) -> Callable[[Batches], Batches]:
    """Every distinct candidate window of a chunk with its hashes and where it comes first."""
    def run(batches: Batches) -> Batches:
        memo = Hashes()
        for batch in batches:
            for chunk, docs, chosen in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                c, at, one, two, _, first = _opened(docs, chosen, memo)
                yield _messages(places, chunk, one[first], [one[first], two[first], c.ids[c.doc[at[first]]],
                                                            c.place[at[first]]])
    return run


def _meet_windows(frame: pd.DataFrame) -> pd.DataFrame:
    """A chunk's window is a repeat if its first place in the chunk is not its first place of all."""
    sizes = [len(b) // 8 for b in frame["a"]]
    one, two = (np.frombuffer(b"".join(frame[k]), np.uint64) for k in "ab")
    doc, place = (np.frombuffer(b"".join(frame[k]), np.int64) for k in "cd")
    order = np.lexsort((np.repeat(frame["chunk"].to_numpy(), sizes), place, doc, two, one))
    again = np.zeros(len(one), bool)
    again[order[1:]] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    return _replied(frame, again, sizes)


def _finish(places: int) -> Callable[[Batches], Batches]:
    """Repeated windows joined to maximal stretches, and what is left of each open document."""
    def run(batches: Batches) -> Batches:
        memo = Hashes()
        for batch in batches:
            for docs, chosen, replies in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                c, at, one, _, group, first = _opened(docs, chosen, memo)
                again = _answers(places, one[first], replies)[group] if len(at) else np.zeros(0, bool)
                own_first = np.zeros(len(at), bool)
                own_first[first] = True
                edge = np.zeros(len(c.doc) + 1, np.int64)
                repeats = at[again | ~own_first]
                np.add.at(edge, repeats, 1)
                np.add.at(edge, repeats + WINDOW, -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed = np.bincount(c.doc, gone, len(c.sizes)).astype(np.int64)
                digests = []
                for k, words in enumerate(c.words):
                    keep = ~gone[c.begin[k]:c.begin[k] + len(words)]
                    digests.append(_digest([w for w, stay in zip(words, keep.tolist()) if stay]))
                yield _result(c.ids.tolist(), c.sizes.tolist(), removed.tolist(), digests)
    return run


REPLY = "chunk long, place long, bits binary"


def _with_replies(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """Each chunk with its replies; a chunk has as many at most as it sent messages."""
    listed = replies.groupBy("chunk").agg(F.collect_list(F.struct("place", "bits")).alias("replies"))
    return chunks.join(listed, "chunk", "left")


def repeated_words(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text).

    A word goes if it lies in a window of ``WINDOW`` words whose word sequence also starts earlier: in a document of
    smaller id, or further ahead in the same one. All windows are judged on the input.

    Anchors are the blocks of ``BLOCK`` words at multiples of ``BLOCK`` of each document; every rolling window of that
    length is a probe. Chunks of documents send the hashes of their distinct windows to meeting places and get one bit
    each back, so a passage in a third of all documents costs a place one entry for a chunk, and no pair of places is
    ever formed. Hits grow to the whole windows around them, which meet in the same way by two 64-bit hashes; windows
    that repeat chain to maximal stretches.

    Null and empty texts have no words. A null doc_id comes after all others. Of rows with one doc_id, one counts as
    the earlier. An empty table gives no rows; other columns are not looked at; texts of any length stay whole.
    """
    spark = docs.sparkSession
    chunks = saved(packed(docs))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = chunks.agg(F.sum("n")).first()[0] or 0
    places = max(least, total // PLACE_HASHES)
    hits = (chunks.select("chunk", "docs").mapInArrow(_anchor_messages(places), "place long, chunk long, a binary, b binary")
            .groupBy("place").applyInPandas(_meet_anchors, REPLY))
    opened = saved(_with_replies(chunks, hits).select("chunk", "docs", "replies").mapInArrow(_candidates(places), OPEN))
    again = (opened.select("chunk", "docs", "chosen").mapInArrow(
        _window_messages(places), "place long, chunk long, a binary, b binary, c binary, d binary")
        .groupBy("place").applyInPandas(_meet_windows, REPLY))
    rest = _with_replies(opened.select("chunk", "docs", "chosen"), again).select(
        "docs", "chosen", "replies").mapInArrow(_finish(places), RESULT)
    done = opened.select(F.explode("done").alias("d")).select("d.doc_id", "d.n_words", F.lit(0).cast("long").alias(
        "n_removed"), "d.kept_sha256")
    return rest.unionByName(done)
