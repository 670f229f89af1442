"""Byte-level BPE encoding through a minimal acyclic transducer of frequent words, exact merging of others, decoding."""

from __future__ import annotations

import json
import re
import tempfile
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tanadex.llm.common import saved
from tanadex.llm.tokens import Pairs, merged

MODEL = "byte_bpe_50k.json"
# Words of the automaton, and how often the corpus must hold them.
FREQUENT = 1 << 16
LEAST = 4
# Bins of word counts for each doubling.
BINS = 8
# Characters (or bytes) encoded together, and length from which a text is looked through for safe cuts.
BATCH_CHARS = 1_000_000
# Ids decoded together.
BATCH_IDS = 250_000
# Fixed value: the pattern that parts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[str, int]:
    """The character by which vocabulary files write each byte: itself if it is visible, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {**{chr(b): b for b in visible}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


class Vocabulary:
    """Ids, merges and bytes of a byte-level BPE file, and the strings that are tokens whatever stands around them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model, level = stored["model"], stored["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges",
                                               "byte_fallback", "fuse_unk"))
        if not (model["type"] == "BPE" and plain and level.get("type") == "ByteLevel" and not level["add_prefix_space"]
                and level["use_regex"] and stored["normalizer"] is None and not any(
                    t[k] for t in stored["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))):
            raise ValueError("only plain byte-level BPE files are read")
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        as_byte = byte_characters()
        self.size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for token, number in model["vocab"].items():
            self.bytes[number] = bytes(as_byte[c] for c in token)
        for token, number in self.special.items():
            self.bytes[number] = token.encode()
        self.first = np.zeros(256, np.int64)
        for char, byte in as_byte.items():
            self.first[byte] = model["vocab"][char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [[model["vocab"][x] for x in (a, b, a + b)] for a, b in pairs]
        self.pairs = Pairs(*map(list, zip(*ids)), list(range(len(ids))), self.size)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word by its merges, as numbers of ids and one flat array."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        ids, owner = merged(symbols, np.repeat(np.arange(len(words)), lengths), len(words), self.pairs)
        return np.bincount(owner, minlength=len(words)), ids


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of a flat array, one after another."""
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    return flat[np.repeat(starts, lengths) + at]


class _State:
    __slots__ = ("edges", "final", "out")

    def __init__(self):
        self.edges, self.final, self.out = [], False, ()


def _shared(a: tuple, b: tuple) -> int:
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    return k


def compiled(entries: list[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The minimal acyclic transducer of words in byte order, each once, with the ids that it puts out.

    A word is added to the open path of its forerunner. What both put out stays on the common edges; the rest moves
    towards the ends. States that the next word cannot change any more are looked up by their final mark and edges:
    equal ones are shared, so that words share their ends as well as their beginnings.
    """
    table: dict[tuple, int] = {}

    def closed(state: _State) -> int:
        return table.setdefault((state.final, state.out, tuple(map(tuple, state.edges))), len(table))

    def close(path: list[_State], down_to: int) -> None:
        while len(path) > down_to + 1:
            last = closed(path.pop())
            path[-1].edges[-1][1] = last

    path, before = [_State()], b""
    for word, ids in entries:
        same = _shared(before, word)
        close(path, same)
        for k in range(same):
            edge, after = path[k].edges[-1], path[k + 1]
            keep = _shared(edge[2], ids)
            moved, edge[2], ids = edge[2][keep:], edge[2][:keep], ids[keep:]
            if moved:
                after.out = moved + after.out if after.final else after.out
                for onward in after.edges:
                    onward[2] = moved + onward[2]
        for k in range(same, len(word)):
            path[k].edges.append([word[k], -1, ids if k == same else ()])
            path.append(_State())
        path[-1].final, before = True, word
    close(path, 0)
    root = closed(path[0])
    keys, targets, outs, finals, pool = [], [], [], np.zeros((len(table), 3), np.int32), []
    places: dict[tuple, int] = {}

    def stored(out: tuple) -> tuple[int, int]:
        if out not in places:
            places[out] = len(pool)
            pool.extend(out)
        return places[out], len(out)

    for (final, out, edges), state in table.items():
        finals[state] = (final, *stored(out))
        for byte, target, ids in edges:
            keys.append(state * 256 + byte)
            targets.append(target)
            outs.append(stored(ids))
    order = np.argsort(keys, kind="stable")
    arrays = [np.array(keys, np.int64)[order], np.array(targets, np.int32)[order],
              np.array(outs, np.int32).reshape(-1, 2)[order], finals, np.array(pool, np.int32)]
    head = np.array([root, len(keys), len(table), len(pool)], np.int64)
    return b"".join(a.tobytes() for a in (head, *arrays))


class Lexicon:
    """A compiled transducer, read in place from a mapped file."""

    def __init__(self, compiled_bytes: bytes):
        with tempfile.TemporaryFile() as file:  # without a name: it leaves nothing behind, even if the task is lost
            file.write(compiled_bytes)
            file.flush()
            mapped = np.memmap(file, np.uint8, "r")
        self.root, edges, states, pool = mapped[:32].view(np.int64).tolist()
        sizes = np.cumsum([32, 8 * edges, 4 * edges, 8 * edges, 12 * states, 4 * pool])
        part = [mapped[a:b] for a, b in zip(sizes, sizes[1:])]
        self.key, self.target, self.out = part[0].view(np.int64), part[1].view(np.int32), part[2].view(np.int32).reshape(-1, 2)
        self.final, self.pool = part[3].view(np.int32).reshape(-1, 3), part[4].view(np.int32)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, numbers of ids, flat ids) of words; all of them walk the automaton side by side, a byte at a time."""
        text = np.frombuffer(b"".join(words), np.uint8)
        length = np.array([len(w) for w in words], np.int64)
        start, known = np.cumsum(length) - length, np.zeros(len(words), bool)
        at, state, steps = np.arange(len(words)), np.full(len(words), self.root), []
        step = 0
        while len(at):
            ended = length[at] == step
            if ended.any():
                here, final = at[ended], self.final[state[ended]]
                known[here] = final[:, 0] == 1
                steps.append((here, final[:, 1], final[:, 2]))
                at, state = at[~ended], state[~ended]
            if not len(at) or not len(self.key):
                break
            key = state * np.int64(256) + text[start[at] + step]
            edge = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            there = self.key[edge] == key
            at, edge = at[there], edge[there]
            state = self.target[edge].astype(np.int64)
            steps.append((at, self.out[edge, 0], self.out[edge, 1]))
            step += 1
        owner, place, size = (np.concatenate([s[k] for s in steps] or [np.zeros(0, np.int64)]) for k in range(3))
        order = np.flatnonzero(known[owner] & (size > 0))
        order = order[np.argsort(owner[order], kind="stable")]
        ids = gathered(self.pool, place[order].astype(np.int64), size[order].astype(np.int64))
        return known, np.bincount(owner[order], size[order], len(words)).astype(np.int64), ids


def _unassigned(last: int) -> re.Pattern:
    """Characters up to ``last`` without a category; what they count as differs between releases of the tables."""
    codes = [c for c in range(last + 1) if unicodedata.category(chr(c)) == "Cn"]
    cuts = [0, *(k for k in range(1, len(codes)) if codes[k] != codes[k - 1] + 1), len(codes)]
    return re.compile("[" + "".join(f"\\U{codes[a]:08x}-\\U{codes[b - 1]:08x}" for a, b in zip(cuts, cuts[1:])) + "]")


class Encoder:
    def __init__(self, path: str, compiled_bytes: bytes):
        import regex
        from tokenizers import pre_tokenizers
        self.vocabulary, self.lexicon = Vocabulary(path), Lexicon(compiled_bytes)
        self.pattern, self.low, self.high = regex.compile(PATTERN), _unassigned(0xFFFF), re.compile("[\U00010000-\U0010ffff]")
        self.level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.safe_cut = re.compile(r"(?<=\S) (?=\S)")

    def odd(self, text: str) -> bool:
        """Whether a text holds characters without a category."""
        return not text.isascii() and bool(self.low.search(text) or self.high.search(text) and any(
            unicodedata.category(c) == "Cn" for c in set(text) if c > "\uffff"))

    def pre_tokens(self, text: str) -> list[str]:
        if self.odd(text):
            return [text[a:b] for _, (a, b) in self.level.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def stretches(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text, a stretch at a time: a single space between visible characters begins a pre-token."""
        for k, part in enumerate(self.vocabulary.parts.split(text) if self.vocabulary.special else [text]):
            if k % 2:
                yield [part]
                continue
            at = 0
            while len(part) - at > BATCH_CHARS:
                cut = self.safe_cut.search(part, at + BATCH_CHARS)
                if not cut:
                    break
                yield self.pre_tokens(part[at:cut.start()])
                at = cut.start()
            if at < len(part):
                yield self.pre_tokens(part[at:])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and flat ids of distinct pre-tokens: from the automaton, or merged."""
        spelled = [w.encode() for w in words]
        known, n, ids = self.lexicon.look_up(spelled)
        strange = np.flatnonzero(~known)
        special = self.vocabulary.special
        marks = [k for k in strange.tolist() if words[k] in special]
        rest = [k for k in strange.tolist() if words[k] not in special]
        more, more_ids = self.vocabulary.merge([spelled[k] for k in rest])
        owner = np.concatenate([np.repeat(np.arange(len(words)), n), np.repeat(np.array(rest, np.int64), more), np.array(marks, np.int64)])
        flat = np.concatenate([ids, more_ids, np.array([special[words[k]] for k in marks], np.int64)])
        return np.bincount(owner, minlength=len(words)), flat[np.argsort(owner, kind="stable")]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and flat ids of texts; distinct pre-tokens are encoded once for the texts given together."""
        index: dict[str, int] = {}
        found, sizes = [], []
        for text in texts:
            n = 0
            for words in self.stretches(text):
                for w in words:
                    if w not in index:
                        index[w] = len(index)
                found.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
                n += len(words)
            sizes.append(n)
        words = np.concatenate(found) if found else np.zeros(0, np.int64)
        n, ids = self.encode_words(list(index))
        lengths = n[words]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        return np.diff(ends), gathered(ids, (np.cumsum(n) - n)[words], lengths)


def frequent_words(texts: DataFrame, size: int = FREQUENT) -> DataFrame:
    """(word, n): pre-tokens of a column ``text`` counted over all rows, so many that no more than ``size`` are kept.

    Counts fall into bins of a fixed grid; the bins that fit from the top give the least count, so no step sorts or
    gathers the words of the corpus.
    """
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("word"))
    counts = saved(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
                   .withColumn("bin", F.floor(BINS * F.log2("n"))))
    kept, least = 0, None
    for r in sorted(counts.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):  # a few hundred bins at most
        kept += r["count"]
        if kept > size:
            break
        least = r["bin"]
    return counts.where(F.col("bin") >= least if least is not None else F.lit(False)).select("word", "n")


def lexicon_of(texts: DataFrame, path: str, size: int = FREQUENT) -> bytes:
    """The compiled transducer of the frequent words of a column ``text``: at most ``size`` words."""
    words = sorted({r["word"].encode() for r in frequent_words(texts, size).collect()})
    n, ids = Vocabulary(path).merge(words)
    ends = np.cumsum(n).tolist()
    flat = ids.tolist()
    return compiled([(w, tuple(flat[b - a:b])) for w, a, b in zip(words, n.tolist(), ends)])


def slices(batch: pa.RecordBatch, sizes: pa.Array, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in order, so many together that their sizes pass ``limit`` by no more than one row."""
    before = np.cumsum(np.append(0, sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(before, before[at] + limit)))
        yield batch.slice(at, min(end, len(batch)) - at)
        at = end


def _path(path: str | None) -> str:
    import public_tokenizers
    return path or public_tokenizers.path(MODEL)


def encoded(docs: DataFrame, path: str | None = None, size: int = FREQUENT) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text): the ids of its whole text; other columns are not looked at.

    The ids are those of the library for the file at ``path``, without added special tokens; special strings inside a
    text are their token, as its default. The most frequent pre-tokens of the corpus, at most ``size``, are compiled
    into a transducer of bounded size, which tasks map and walk; others are merged exactly, so the transducer changes
    no result. A null or empty text has no ids. Texts of any length are encoded whole; repeated rows alike; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lexicon = spark.sparkContext.broadcast(lexicon_of(texts, _path(path), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_path(path), lexicon.value)
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column(1)), BATCH_CHARS):
                n, ids = encoder.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])
    return texts.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` (doc_id, ids) with ``text``, the text of the ids, special tokens included, as the library decodes them.

    Bytes that are no valid UTF-8 become replacement characters; ids outside the vocabulary put out nothing; null ids
    have a null text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = Vocabulary(_path(path)).bytes
        length = np.array([*map(len, spelled), 0], np.int64)
        start, flat = np.cumsum(length) - length, np.frombuffer(b"".join(spelled), np.uint8)
        for batch in batches:
            for part in slices(batch, pc.list_value_length(batch.column(1)), BATCH_IDS):
                lists = part.column(1)
                ids = lists.flatten()
                ids = (ids.fill_null(-1) if ids.null_count else ids).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = np.where((ids < 0) | (ids >= len(spelled)), len(spelled), ids)
                ends = np.concatenate([[0], np.cumsum(length[ids])])
                n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                whole = gathered(flat, start[ids], length[ids]).tobytes()
                cuts = ends[np.concatenate([[0], np.cumsum(n)])].tolist()
                texts = [whole[a:b].decode("utf-8", "replace") if valid else None
                         for a, b, valid in zip(cuts, cuts[1:], lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
