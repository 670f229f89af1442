"""Language ID by unigram pieces of each language, summed over all segmentations of each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tanadex.llm.common import SPACE, saved

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = "und"
# Fitted on at most so many labelled documents of each language, those of smallest hash.
SAMPLE_DOCS = 500
ROUNDS = 2
SMOOTHING = 0.1
# Probability of a character that is no piece, alike in every language.
STRAY = 1e-7
# Longer words are scored in stretches of so many characters, which keeps products within floating range.
STRETCH = 28
KEPT_WORDS = 400_000
LEARN_WORDS = 20_000
# Texts whose words are learnt together; a longer text learns its own.
BATCH_TEXTS = 1000
LONG_TEXT = 1_000_000
# Characters that do not count at the edges of a word, and the multiplier of the substring hash.
EDGES = ".,;:!?\"'()[]{}|#$%&*<>-+=/"
BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The text pieces of a public vocabulary, in lower case, found by hashes of all substrings of one length at once."""

    def __init__(self, names: list[str]):
        self.names = list(dict.fromkeys(names))
        self.stray, self.none, self.size = len(self.names), len(self.names) + 1, len(self.names) + 2
        by_length: dict[int, list[int]] = {}
        for k, p in enumerate(self.names):
            by_length.setdefault(len(p), []).append(k)
        self.tables = {}
        for n, numbers in by_length.items():
            keys = hashed(codes_of([self.names[k] for k in numbers], n), n)[:, 0]
            order = np.argsort(keys)
            self.tables[n] = keys[order], np.array(numbers, np.int32)[order]

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([model.id_to_piece(k).lower() for k in range(model.get_piece_size())
                    if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))])

    def find(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """By length, the piece that begins at each place of strings of equal length. A single character that is no
        piece is the stray one; ``none`` stands where there is no piece."""
        out = {}
        for n, (keys, numbers) in self.tables.items():
            if n <= codes.shape[1]:
                h = hashed(codes, n)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                out[n] = np.where(keys[at] == h, numbers[at], self.stray if n == 1 else self.none)
        if codes.shape[1] and 1 not in out:
            out[1] = np.full(codes.shape, self.stray)
        return out


def codes_of(strings: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(len(strings), width).astype(np.uint64)


def hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every substring of ``n`` characters."""
    last = codes.shape[1] - n + 1
    h = np.zeros((len(codes), last), np.uint64)
    for k in range(n):
        h = (h ^ codes[:, k:k + last]) * BASE
        h ^= h >> np.uint64(29)
    return h


def forward(found: dict[int, np.ndarray], width: int, probability: np.ndarray) -> list[np.ndarray]:
    """Sum over the segmentations of each prefix, by prefix length: (string, language)."""
    rows = found[1].shape[0] if found else 0
    alpha = [np.ones((rows, probability.shape[1]))]
    for t in range(1, width + 1):
        total = 0
        for n, at in found.items():
            if n <= t:
                total = total + alpha[t - n] * probability[at[:, t - n]]
        alpha.append(total)
    return alpha


def totals(strings: list[str], pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """Probability of each string in each language, summed over all its segmentations."""
    out = np.ones((len(strings), probability.shape[1]))
    for width, rows in _by_length(strings):
        found = pieces.find(codes_of([strings[k] for k in rows], width))
        out[rows] = forward(found, width, probability)[width]
    return out


def expected(strings: list[str], pieces: Pieces, probability: np.ndarray, weight: np.ndarray, language: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, per language; string k counts ``weight`` times in its language."""
    langs = probability.shape[1]
    out = np.zeros(probability.size)
    for width, rows in _by_length(strings):
        found, own = pieces.find(codes_of([strings[k] for k in rows], width)), language[rows]
        alpha = [a[np.arange(len(rows)), own] for a in forward(found, width, probability)]
        beta = [np.zeros(len(rows)) for _ in range(width)] + [weight[rows] / alpha[width]]
        for t in range(width, 0, -1):
            for n, at in found.items():
                if n <= t:
                    p = probability[at[:, t - n], own]
                    out += np.bincount(at[:, t - n] * langs + own, alpha[t - n] * p * beta[t], len(out))
                    beta[t - n] += p * beta[t]
    return out.reshape(probability.shape)


def _by_length(strings: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    size = np.array([len(s) for s in strings])
    order = np.argsort(size, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        for at in range(0, len(rows), LEARN_WORDS):
            if len(rows) and size[rows[0]]:
                yield int(size[rows[0]]), rows[at:at + LEARN_WORDS]


def stretches(word: str) -> list[str]:
    return [MARK + word[:STRETCH], *[word[k:k + STRETCH] for k in range(STRETCH, len(word), STRETCH)]]


def _default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def held_out(doc_id) -> object:
    """Whether a row is kept from learning; a null id is neither held out nor learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their piece probabilities (piece, language), by expectation maximisation.

    Learns from the text and lang of rows that are not held out and have a lang: of each language the
    ``SAMPLE_DOCS`` documents of smallest hash. Words are counted and pieces summed by Spark; what reaches the driver
    is one number per piece and language.
    """
    path = path or _default_path()
    pieces = Pieces.load(path)
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (usable.select("doc_id", "lang").distinct().withColumn("k", F.row_number().over(order))
           .where(F.col("k") <= SAMPLE_DOCS).select("doc_id", "lang"))
    # The ids are bounded by SAMPLE_DOCS for each language, so they may be broadcast.
    texts = usable.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    words = saved(texts.select("lang", F.explode(F.split(F.lower("text"), SPACE)).alias("word"))
                  .select("lang", F.trim("word", F.lit(EDGES)).alias("word")).where("word <> ''")
                  .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).repartition(F.col("word")))
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    number = {x: k for k, x in enumerate(langs)}
    probability = np.full((pieces.size, len(langs)), 1 / pieces.size)
    probability[pieces.stray:] = [[STRAY], [0]]
    for _ in range(ROUNDS if langs else 0):
        def uses(frames: Iterator[pd.DataFrame], p=probability) -> Iterator[pd.DataFrame]:
            known, total = Pieces.load(path), np.zeros(p.shape)
            for frame in frames:
                strings, weight, lang = [], [], []
                for x, w, n in frame.itertuples(index=False):
                    for s in stretches(w):
                        strings.append(s)
                        weight.append(n)
                        lang.append(number[x])
                total += expected(strings, known, p, np.array(weight, float), np.array(lang, np.int64))
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "uses": total[piece, lang]})
        found = (words.select("lang", "word", "n").mapInPandas(uses, "piece long, lang long, uses double")
                 .groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas())
        counts = np.zeros(probability.shape)
        counts[found["piece"], found["lang"]] = found["uses"]
        counts[:pieces.stray] += SMOOTHING
        probability = counts / counts[:pieces.stray].sum(axis=0)
        probability[pieces.stray:] = [[STRAY], [0]]
    return langs, probability


class Scorer:
    """Log-likelihoods of words in every language, each word scored once, without case and outer punctuation."""

    def __init__(self, path: str, probability: np.ndarray):
        self.pieces, self.probability = Pieces.load(path), probability
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.core: dict[str, int] = {"": 0}
        self.rows = np.zeros((1, self.probability.shape[1]))

    def learn(self, words: set[str]) -> None:
        cores = {w: w.lower().strip(EDGES) for w in words if w not in self.place}
        new = [c for c in set(cores.values()) if c not in self.core]
        if new:
            parts = [stretches(c) for c in new]
            flat = np.log(totals([s for p in parts for s in p], self.pieces, self.probability))
            self.core.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, np.add.reduceat(flat, np.cumsum([0, *[len(p) for p in parts[:-1]]]), axis=0)])
        self.place.update((w, self.core[c]) for w, c in cores.items())

    def total(self, text: str) -> np.ndarray:
        words, total = text.split(), np.zeros(self.probability.shape[1])
        for at in range(0, len(words), KEPT_WORDS):
            part = words[at:at + KEPT_WORDS]
            if len(words) > KEPT_WORDS:
                self.forget()
            self.learn({w for w in part if w not in self.place})
            total += self.rows[np.fromiter(map(self.place.__getitem__, part), np.int64, len(part))].sum(axis=0)
        return total


def predictions(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang).

    A text's log-likelihood in a language is the sum over its words, white space apart and in lower case, of the log
    of the sum over all segmentations into pieces of the product of their probabilities. Outer punctuation of a word is
    left out, and a word of more than ``STRETCH`` characters is cut into stretches, so segmentations over a cut are
    not in the sum. score is the share of the
    best language among all, with equal priors; ties go to the first language. Null texts, texts without a letter,
    and all texts if nothing could be learnt get ``und`` and score 0. Repeated rows are judged alike; an empty table
    gives no rows.
    """
    path = path or _default_path()
    langs, probability = fit(docs.select("doc_id", "text", "lang"), path)

    def judge(total: np.ndarray) -> tuple[str, float]:
        best = int(total.argmax())
        return langs[best], float(1 / np.exp(total - total[best]).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(path, probability)
        for part in (b.slice(at, BATCH_TEXTS) for b in batches for at in range(0, len(b), BATCH_TEXTS)):
            texts = part.column(1).to_pylist()
            plain = [bool(langs) and t is not None and any(map(str.isalpha, t)) for t in texts]
            if len(scorer.place) > KEPT_WORDS:
                scorer.forget()
            scorer.learn(set().union(*[t.split() for t, ok in zip(texts, plain) if ok and len(t) < LONG_TEXT]))
            found = [judge(scorer.total(t)) if ok else (UNKNOWN, 0.0) for t, ok in zip(texts, plain)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([x for x, _ in found], pa.string()),
                 pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])
    judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double")
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
