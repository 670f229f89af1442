"""Best-fit packing: token pieces into sequences by a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tanadex.llm.common import saved
from tanadex.llm.tokens import Pairs, merged

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
# Fixed value: the id that ends each document.
END_ID = 1
# Pieces of a shard in the mean; a shard is one packing problem, so it bounds a task.
SHARD_PIECES = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 8
# Encoded words that a task keeps, and texts whose words are encoded together.
KEPT_WORDS = 1_200_000
BATCH_TEXTS = 500
# Lower-case lines that the pre-tokenizer parts in two (others give nothing), and letters that lower case
# and normal form leave alone.
REGULAR = re.compile(r"^(?:([a-zà-öø-ÿ]+)([!-/:-@\[-`{-~]*)|.*)$", re.M)
LETTERS = re.compile(r"[a-zà-öø-ÿ]+")


class LetterMerges:
    """Ids of lower-case words of letters, merged together in one array by the vocabulary's own merges.

    A word is its UTF-8 bytes, each written as the character that stands for it in the vocabulary; the last carries
    the mark of a word's end.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        # Bytes that can be printed stand for themselves, the others for the characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner = np.array([ids[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([ids[letter[b] + end] for b in range(256)], np.int64)
        made = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = Pairs([ids[a] for a, _ in made], [ids[b] for _, b in made], [ids[a + b] for a, b in made],
                           list(range(len(made))), max(ids.values()) + 1)

    def ids(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        points = np.frombuffer(b"".join(raw), np.uint8)
        sym, ends = self.inner[points], np.cumsum(size) - 1
        sym[ends] = self.last[points[ends]]
        sym, seq = merged(sym, np.repeat(np.arange(len(raw)), size), len(raw), self.pairs)
        data, at = sym.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=len(raw))))) * 4
        return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


class WordIds(dict):
    """Token ids of white-space-parted words, as bytes. The pre-tokenizer never joins words over white space.

    New words of Latin letters with a tail of ASCII punctuation are parted there, as the pre-tokenizer does, and their
    letters are merged together; all other words and the tails are encoded by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer, self.letters = Tokenizer.from_file(path), LetterMerges(path)
        self.parts: dict[str, bytes] = {"": b""}

    def encode(self, words: list[str]) -> None:
        plain = [w for w in words if LETTERS.fullmatch(w)]
        for at in range(0, len(plain), 50_000):
            self.parts.update(zip(plain[at:at + 50_000], self.letters.ids(plain[at:at + 50_000])))
        for word in words:
            if word not in self.parts:
                self.parts[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        if len(self) + len(self.parts) > KEPT_WORDS:
            self.clear()
            self.parts = {"": b""}
        new = [w for w in words if w not in self]
        if new:
            joined = b"\n".join(new).decode()  # no word holds a line end
            heads, tails = map(list, zip(*REGULAR.findall(joined.lower())))
            if "" in heads:
                whole = joined.split("\n")
                heads = [h or w for h, w in zip(heads, whole)]
            self.encode(list((set(heads) | set(tails)) - self.parts.keys()))
            get = self.parts.__getitem__
            self.update(zip(new, map(add, map(get, heads), map(get, tails))))

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text, little-endian, with the end id."""
        split = [t.split() for t in texts]  # bytes part at ASCII white space only
        self.learn(set().union(*split))
        end = END_ID.to_bytes(4, "little")
        for words in split:
            yield b"".join(map(self.__getitem__, words)) + end


def token_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document cut into pieces of at most ``CAPACITY`` tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        words = WordIds(path or public_tokenizers.path(VOCABULARY))
        for batch in (part.slice(at, BATCH_TEXTS) for part in batches for at in range(0, len(part), BATCH_TEXTS)):
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.ids([t or b"" for t in batch.column(1).to_pylist()])):
                for k, at in enumerate(range(0, len(ids), 4 * CAPACITY)):
                    part = ids[at:at + 4 * CAPACITY]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                doc, piece, start, length, crc = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long"))


Bins = list[list[int]]


def best_fit(bins: Bins, loose: list[int], size: list[int]) -> Bins:
    """Put loose items, largest first, each into the fullest bin that has room, or into a new one."""
    bins = [list(b) for b in bins]
    room = [CAPACITY - sum(size[i] for i in b) for b in bins]
    free = sorted((r, k) for k, r in enumerate(room) if r)
    for item in sorted(loose, key=lambda i: -size[i]):
        at = bisect_left(free, (size[item], -1))
        if at < len(free):
            left, k = free.pop(at)
            left -= size[item]
        else:
            left, k = CAPACITY - size[item], len(bins)
            bins.append([])
        bins[k].append(item)
        if left:
            insort(free, (left, k))
    return bins


def fitness(bins: Bins, size: list[int]) -> tuple[float, float]:
    """Fewer bins first; among equals fuller bins, by the sum of squared fill."""
    return -len(bins), sum(sum(size[i] for i in b) ** 2 for b in bins)


def crossover(mother: Bins, father: Bins, size: list[int], rng: np.random.Generator) -> Bins:
    """Inject whole well-filled bins of the father; the mother's bins that share items with them are dissolved and the
    items so displaced are best-fitted again."""
    fill = np.array([sum(size[i] for i in b) for b in father])
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    given = [father[k] for k in rng.choice(good, max(1, len(good) // 2), replace=False)]
    taken = {i for b in given for i in b}
    whole, loose = [], []
    for b in mother:
        if taken.isdisjoint(b):
            whole.append(b)
        else:
            loose += [i for i in b if i not in taken]
    return best_fit([*given, *whole], loose, size)


def mutated(bins: Bins, size: list[int], rng: np.random.Generator) -> Bins:
    """Dissolve the emptiest bins and a few others, and best-fit their items again."""
    fill = np.array([sum(size[i] for i in b) for b in bins])
    out = {*np.argsort(fill, kind="stable")[:2].tolist(), *rng.choice(len(bins), min(len(bins), 3), replace=False).tolist()}
    return best_fit([b for k, b in enumerate(bins) if k not in out], [i for k in out for i in bins[k]], size)


def evolve(size: list[int], elites: list[Bins], seed: int) -> Bins:
    """The best grouping after some generations, begun from elites and best-fit groupings in disturbed orders.

    Stops early at the least number of bins that the sum of sizes allows.
    """
    rng, least = np.random.default_rng(seed), -(-sum(size) // CAPACITY)
    herd = sorted([*elites, best_fit([], list(range(len(size))), size)], key=lambda b: fitness(b, size), reverse=True)
    if len(herd[0]) > least:
        while len(herd) < POPULATION:
            herd.append(mutated(herd[0], size, rng))
    herd.sort(key=lambda b: fitness(b, size), reverse=True)
    for _ in range(GENERATIONS):
        if len(herd[0]) <= least:
            break
        child = crossover(herd[0], herd[int(rng.integers(1, len(herd)))], size, rng)
        if rng.random() < 0.5:
            child = mutated(child, size, rng)
        herd = sorted([*herd, child], key=lambda b: fitness(b, size), reverse=True)[:POPULATION]
    return herd[0]


def _bins(numbers: np.ndarray) -> Bins:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(numbers.tolist()):
        out.setdefault(k, []).append(i)
    return list(out.values())


def _island(epoch: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One epoch of one island of a shard: begun from its own elite and its neighbour's, if there are any."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item", kind="stable").reset_index(drop=True)
        elites = [_bins(frame[c].to_numpy()) for c in ("own", "guest") if epoch]
        seed = int(frame["shard"].iat[0]) * 1009 + int(frame["island"].iat[0]) * 31 + epoch
        bins = evolve(frame["length"].tolist(), elites, seed)
        number = np.empty(len(frame), np.int64)
        for k, b in enumerate(bins):
            number[b] = k
        return pd.DataFrame({"shard": frame["shard"], "island": frame["island"], "item": frame["item"],
                             "length": frame["length"], "own": number, "n_bins": len(bins)})
    return run


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Whole pieces of ``CAPACITY`` tokens are sequences of their own. The others are dealt by hash into shards of about
    ``SHARD_PIECES``; each shard evolves on ``ISLANDS`` islands, whose elites move on to the next island between
    epochs, and the best island's grouping stands. A null or empty text is one piece with the end id alone. Repeated
    rows are packed as documents of their own, ties go by item number, an empty table gives no rows, and columns
    other than doc_id and text are not looked at.
    """
    pieces = saved(token_pieces(docs, path).withColumn("item", F.monotonically_increasing_id()))
    small = pieces.where(F.col("length") < CAPACITY)
    shards = max(1, round(small.count() / SHARD_PIECES))
    state = (small.select(F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard"), "item", "length",
                          F.lit(-1).cast("long").alias("own"), F.lit(-1).cast("long").alias("guest"),
                          F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")))
    schema = "shard long, island int, item long, length long, own long, n_bins long"
    for epoch in range(EPOCHS):
        state = saved(state.groupBy("shard", "island").applyInPandas(_island(epoch), schema))
        moved = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), "item",
                             F.col("own").alias("guest"))
        best, state = state, state.join(moved, ["shard", "island", "item"])
    winner = best.groupBy("shard").agg(F.min(F.struct("n_bins", "island")).alias("w")).select("shard", "w.island")
    chosen = best.join(winner, ["shard", "island"]).select("item", (F.col("shard") * SHARD_PIECES * 1024 + F.col("own"))
                                                          .alias("sequence_id"))
    found = pieces.join(chosen, "item", "left").withColumn(
        "sequence_id", F.coalesce("sequence_id", -1 - F.col("item")))

    ahead = W.partitionBy("sequence_id").orderBy("item").rowsBetween(W.unboundedPreceding, -1)
    return found.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("item")
