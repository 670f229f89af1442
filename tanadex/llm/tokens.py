"""Token counts by rank-synchronous merging of ragged arrays, equal to the library's own for a BPE piece model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
# Counted pre-tokens that a task keeps, and characters merged at a time.
KEPT_WORDS = 400_000
BATCH_CHARS = 2_000_000
BATCH_TEXTS = 1000
# Longer words are looked through for safe cuts.
LONG = 64
# Fixed value: the mark that stands for a space.
MARK = "▁"
NEVER = np.int64(1) << 60


class Merges:
    """Symbols and merge ranks of a piece vocabulary, as sorted arrays.

    A merge of two symbols is allowed if their concatenation is a piece; its rank is the piece's place by score, equal
    scores sharing a rank. Characters that no piece holds are no symbols: each stands for its bytes.
    """

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [k for k in range(model.get_piece_size())
                 if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        score = {model.id_to_piece(k): model.get_score(k) for k in plain}
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        names = dict.fromkeys([*score, *sorted({c for p in score for c in p})])
        self.symbol = {p: k for k, p in enumerate(names)}
        self.loose = np.array([0 if p in score else len(p.encode()) for p in names], np.int64)
        left, right, into, rank = [], [], [], []
        for p, value in score.items():
            for cut in range(1, len(p)):
                if p[:cut] in self.symbol and p[cut:] in self.symbol:
                    left.append(self.symbol[p[:cut]])
                    right.append(self.symbol[p[cut:]])
                    into.append(self.symbol[p])
                    rank.append(place[value])
        self.pairs = Pairs(left, right, into, rank, len(self.symbol))
        # Two characters that stand side by side in no piece are always in different tokens.
        self.beside = {p[k:k + 2] for p in score for k in range(len(p) - 1)}
        self.longest_run = max((len(p) for p in score if set(p) == {MARK}), default=1)



class Pairs:
    """Merges of symbol pairs: a rank, low ones first, and the symbol that comes of each."""

    def __init__(self, left: list[int], right: list[int], into: list[int], rank: list[int], size: int):
        key = np.array(left, np.int64) * size + np.array(right, np.int64)
        order = np.argsort(key)
        self.size, self.key = size, np.append(key[order], NEVER)
        self.into = np.append(np.array(into, np.int64)[order], 0)
        self.rank = np.append(np.array(rank, np.int64)[order], NEVER)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NEVER`` if there is no merge) and result of each pair of symbols; -1 is no symbol."""
        key = left * self.size + right
        at = np.searchsorted(self.key, key)
        found = (self.key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.rank[at], NEVER), self.into[at]


def merged(sym: np.ndarray, seq: np.ndarray, n: int, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that survive in each of ``n`` sequences, which lie one after another in a flat array.

    In each round every sequence finds its lowest-ranked pair, and all sequences apply theirs at once: from the left,
    every place of that pair which does not overlap one already applied. If such a merge opens a pair of the same or
    a lower rank beside it, the places right of it wait for the next round, as they would in one-by-one merging.
    """
    done, rank, into = [], *pairs.find(sym[:-1], np.where(seq[1:] == seq[:-1], sym[1:], -1))
    rank, into = np.append(rank, NEVER)[:len(sym)], np.append(into, 0)[:len(sym)]  # of each symbol with the next
    while len(sym):
        starts = np.flatnonzero(np.diff(seq, prepend=-1))
        least = np.full(n, NEVER)
        least[seq[starts]] = np.minimum.reduceat(rank, starts)
        # Sequences without a pair left are done.
        live = least[seq] < NEVER
        done.append((sym[~live], seq[~live]))
        sym, seq, rank, into = sym[live], seq[live], rank[live], into[live]
        places = np.flatnonzero((rank < NEVER) & (rank == least[seq]))
        # In a run of overlapping places every second one counts, from the run's first.
        run = np.flatnonzero(np.diff(places, prepend=-2) != 1)
        inside = np.arange(len(places)) - np.repeat(run, np.diff(np.append(run, len(places))))
        places = places[inside % 2 == 0]
        new, owner = into[places], seq[places]
        touched = np.append(False, (np.diff(places) == 2) & (owner[1:] == owner[:-1]))[:len(places)]
        before_at = places - np.where(touched, 2, 1)
        before = np.where((places > 0) & (seq[places - 1] == owner), sym[before_at], -1)
        before[touched] = new[np.flatnonzero(touched) - 1]
        after_at = np.minimum(places + 2, len(sym) - 1)
        after = np.where((places + 2 < len(sym)) & (seq[after_at] == owner), sym[after_at], -1)
        (left_rank, left_into), (right_rank, right_into) = pairs.find(before, new), pairs.find(new, after)
        opens = np.minimum(left_rank, right_rank) <= rank[places]
        # A place stands if no earlier place of its sequence in this round opened such a pair.
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        total = np.cumsum(opens) - opens
        stands = total == np.repeat(total[first], np.diff(np.append(first, len(owner))))
        at, some = places[stands], stands & (before >= 0)
        sym[at], rank[at], into[at] = new[stands], right_rank[stands], right_into[stands]
        rank[before_at[some]], into[before_at[some]] = left_rank[some], left_into[some]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, seq, rank, into = sym[keep], seq[keep], rank[keep], into[keep]
    sym, seq = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
    order = np.argsort(seq, kind="stable")
    return sym[order], seq[order]


def merged_counts(words: list[str], merges: Merges) -> np.ndarray:
    """Tokens of each pre-token; a character that is no symbol counts its bytes."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    distinct, inverse = np.unique(points, return_inverse=True)
    known = np.array([merges.symbol.get(chr(c), -1) for c in distinct.tolist()], np.int64)
    width = np.array([len(chr(c).encode()) for c in distinct.tolist()], np.int64)
    sym, seq = merged(known[inverse], np.repeat(np.arange(len(words)), [len(w) for w in words]), len(words), merges.pairs)
    strange = np.bincount(np.repeat(np.arange(len(words)), [len(w) for w in words])[known[inverse] < 0],
                          width[inverse][known[inverse] < 0], len(words))
    return np.bincount(seq[sym >= 0], minlength=len(words)) + strange.astype(np.int64)


class Counter:
    """Token counts of words, each learnt once: with the mark of one space before it, and without."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        if (self.merges.loose > 1).any():
            raise ValueError("a character of a piece is no piece itself: its bytes must be counted")
        self.tied: dict[str, int] = {}
        self.bare: dict[str, int] = {}
        self.runs: dict[int, int] = {}
        self.joins: dict[str, bool] = {}

    def run(self, n: int) -> int:
        """Tokens of n marks in a row: they fill the longest piece from the left, then the rest."""
        top = self.merges.longest_run
        if n not in self.runs:
            self.runs[n] = n // top + (int(merged_counts([MARK * (n % top)], self.merges)[0]) if n % top else 0)
        return self.runs[n]

    def learn(self, counts: dict[str, int], words: set[str], before: str) -> None:
        """Count new words together, ``BATCH_CHARS`` at a time; long ones are cut where no piece can reach over."""
        new = [w for w in words if w not in counts]
        parts, owner, chars, beside = [], [], 0, self.merges.beside
        for k, word in enumerate(new):
            counts[word] = 0
            word = before + word
            at = 0
            for cut in range(1, len(word) if len(word) > LONG else 0):
                if word[cut - 1:cut + 1] not in beside:
                    parts.append(word[at:cut])
                    owner.append(k)
                    at = cut
            parts.append(word[at:])
            owner.append(k)
            chars += len(word)
            if chars > BATCH_CHARS or k + 1 == len(new):
                for i, n in zip(owner, merged_counts(parts, self.merges).tolist()):
                    counts[new[i]] += n
                parts, owner, chars = [], [], 0

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts. No piece holds a mark behind another character, so each word starts anew."""
        if len(self.tied) + len(self.bare) > KEPT_WORDS:
            self.tied.clear()
            self.bare.clear()
            self.joins.clear()
        split = [t.replace(MARK, " ").split(" ") if t else [] for t in texts]
        known = set().union(*split)
        wide = "" in known
        known.discard("")
        self.learn(self.tied, known, MARK)
        if wide:
            self.learn(self.bare, {w for parts in split for v, w in zip(["", *parts], parts) if w and not v}, "")
        return [self.count_words(parts) if "" in parts else sum(map(self.tied.__getitem__, parts)) for parts in split]

    def count_words(self, parts: list[str]) -> int:
        """``parts`` are what stands between spaces; an empty one means one more space.

        A word takes along the last mark before it; further marks join among themselves. Where the mark joins
        nothing of the word, all marks are one run.
        """
        total, spaces = 0, 1
        for w in parts:
            if not w:
                spaces += 1
            else:
                if spaces == 1:
                    total += self.tied[w]
                elif self.tied[w] == self.bare[w] + 1 and not self.joined(w):
                    total += self.bare[w] + self.run(spaces)
                else:
                    total += self.tied[w] + self.run(spaces - 1)
                spaces = 1
        return total + (self.run(spaces - 1) if spaces > 1 else 0)

    def joined(self, word: str) -> bool:
        """Whether the mark before a word merges with it: the first token up to the first safe cut is not the mark."""
        beside, symbol = self.merges.beside, self.merges.symbol
        if MARK + word[0] not in beside:
            return False
        if word not in self.joins:
            whole = MARK + word
            cut = next((k for k in range(2, len(whole)) if whole[k - 1:k + 1] not in beside), len(whole))
            symbols = np.array([symbol.get(c, -1) for c in whole[:cut]], np.int64)
            self.joins[word] = bool(merged(symbols, np.zeros(cut, np.int64), 1, self.merges.pairs)[0][0] != symbol[MARK])
        return self.joins[word]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text); other columns are not looked at.

    A null or empty text has no bytes and no tokens. Texts of any length are counted whole; repeated rows are
    counted alike; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        counter = Counter(path or public_tokenizers.path(MODEL))
        for batch in batches:
            for at in range(0, len(batch), BATCH_TEXTS):
                part = batch.slice(at, BATCH_TEXTS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array(counter.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
