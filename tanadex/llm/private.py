"""Personal data: identifiers as written, and identifiers found behind disguises, mapped back to the source text."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, place of the kind in KINDS, end

# The identifiers. An e-mail is sought from its sign outwards, which finds the same spans.
SIGN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters that look like Latin ones, and what they look like.
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινρ",
                      "ABESIJKMHOPCTYXaesijopcyxdhqwlABEZHIKMNOPTYXoivp"))
MARKS = dict(zip("‐‑‒–—−﹣。｡․·﹒＠﹫", "------" + "-" + "....." + "@@"))
UNSEEN = frozenset("​‌‍⁠﻿­")

# Spelled digits.
DIGITS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
          "eight": "8", "nine": "9", "dot": ".", "point": ".", "plus": "+"}
NUMBER = "zero|one|two|three|four|five|six|seven|eight|nine"
SPELLED = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:(?:plus|\+)[ -]?)?(?:{NUMBER}|[0-9])"
                     rf"(?:[ ,-]{{1,2}}(?:{NUMBER}|[0-9]|dot|point)(?![A-Za-z0-9])){{6,}}")
TOKEN = re.compile(rf"(?i){NUMBER}|dot|point|plus|[0-9+]")
HINT = re.compile(rf"(?i)(?<![A-Za-z])(?:{NUMBER})(?![A-Za-z])")
OPEN_AT = re.compile(r"(?i)[ \t]?[(\[{<][ \t]?(?:at|@)[ \t]?[)\]}>][ \t]?")
OPEN_DOT = re.compile(r"(?i)[ \t]?[(\[{<][ \t]?(?:dot|\.)[ \t]?[)\]}>][ \t]?")
WIDE_AT = re.compile(r"(?<=[A-Za-z0-9]) @ ?(?=[A-Za-z0-9-]+\.)|(?<=[A-Za-z0-9])@ (?=[A-Za-z0-9-]+\.[A-Za-z0-9])")
WORD_AT = re.compile(r"(?i)(?<=[a-z0-9_%+-])[ \t]at[ \t](?=[a-z0-9-]+(?:[ \t]dot[ \t][a-z0-9-]+)+)")
WORD_DOTS = re.compile(r"(?i)[a-z0-9-]+(?:[ \t]dot[ \t][a-z0-9-]+)+")
LOCAL_DOTS = re.compile(r"(?i)(?:[a-z0-9_%+-]+[ \t]dot[ \t])+[a-z0-9_%+-]+$")
WORD_DOT = re.compile(r"(?i)[ \t]dot[ \t]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in SIGN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def _is_card(digits: str) -> bool:
    if not 14 <= len(digits) <= 19:
        return False
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _is_ip(text: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in text.split(".")))


def identifiers(text: str) -> list[Span]:
    """Leftmost non-overlapping identifiers of each kind; a match that fails its test is dropped and not retried."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _is_ip(m[0])]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if _is_card(re.sub("[^0-9]", "", m[0]))]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text)
                  if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


def _plain(c: str) -> str:
    """What a character stands for: a look-alike's Latin letter, a digit's value, a space, nothing, or itself."""
    if c < "\x80":
        return c
    if c in UNSEEN:
        return ""
    if c in LOOKALIKES or c in MARKS:
        return LOOKALIKES.get(c) or MARKS[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    if (kind := unicodedata.category(c)) == "Nd":
        return str(unicodedata.digit(c))
    if kind == "Zs":
        return " "
    if "\U0001d400" <= c <= "\U0001d7ff":
        return unicodedata.normalize("NFKC", c)
    return c


class Rewritten:
    """A text with edits applied; each character knows the span of the source it came from."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None

    def edit(self, edits: list[tuple[int, int, list[tuple[int, int, str]]]]) -> None:
        """Replace spans; each new character is given as (from, to, character) in the present text."""
        if not edits:
            return
        old_start = self.start or range(len(self.text))
        old_end = self.end or range(1, len(self.text) + 1)
        text, start, end, at = [], [], [], 0
        for a, b, chars in [*sorted(edits), (len(self.text), len(self.text), [])]:
            if a < at:
                continue
            text.append(self.text[at:a])
            start += old_start[at:a]
            end += old_end[at:a]
            for x, y, c in chars:
                text.append(c)
                start.append(old_start[x])
                end.append(old_end[y - 1])
            at = b
        self.text, self.start, self.end = "".join(text), start, end

    def back(self, span: Span) -> Span:
        a, kind, b = span
        return (a, kind, b) if self.start is None else (self.start[a], kind, self.end[b - 1])


def _glyph_edits(text: str) -> list:
    if text.isascii():
        return []
    change = {c: p for c in set(text) if (p := _plain(c)) != c}
    if not change:
        return []
    found = re.compile("[" + re.escape("".join(sorted(change))) + "]")
    return [(m.start(), m.end(), [(m.start(), m.end(), change[m[0]])] if change[m[0]] else [])
            for m in found.finditer(text)]


def _one(m: re.Match, c: str, at: int = 0) -> tuple:
    return m.start() + at, m.end() + at, [(m.start() + at, m.end() + at, c)]


def _address_edits(text: str) -> list:
    edits = []
    if "(" in text or "[" in text or "{" in text or "<" in text:
        edits += [_one(m, "@") for m in OPEN_AT.finditer(text)] + [_one(m, ".") for m in OPEN_DOT.finditer(text)]
    if "@" in text:
        edits += [_one(m, "@") for m in WIDE_AT.finditer(text)]
        edits = sorted(set((a, b, tuple(c)) for a, b, c in edits))
    for m in WORD_AT.finditer(text) if WORD_DOT.search(text) else ():
        edits.append(_one(m, "@"))
        domain = WORD_DOTS.match(text, m.end())
        edits += [_one(d, ".", domain.start()) for d in WORD_DOT.finditer(domain[0])]
        low = max(0, m.start() - 64)
        if local := LOCAL_DOTS.search(text[low:m.start()]):
            edits += [_one(d, ".", low + local.start()) for d in WORD_DOT.finditer(local[0])]
    return [(a, b, list(c)) for a, b, c in edits]


def _digit_edits(text: str) -> list:
    edits = []
    for m in SPELLED.finditer(text) if HINT.search(text) else ():
        if HINT.search(m[0]):
            edits.append((m.start(), m.end(), [(m.start() + t.start(), m.start() + t.end(), DIGITS.get(t[0].lower(), t[0]))
                                               for t in TOKEN.finditer(m[0])]))
    return edits


def disguised(text: str) -> list[Span]:
    """Identifiers of the normalised text, as spans of the source; none if nothing had to be normalised."""
    work = Rewritten(text)
    for edits in (_glyph_edits, _address_edits, _digit_edits):
        work.edit(edits(work.text))
    return [] if work.start is None else [work.back(s) for s in identifiers(work.text)]


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: what is found behind disguises joins them unless it lies inside a base span."""
    base = identifiers(text)
    more = [s for s in disguised(text) if not any(k == s[1] and a <= s[0] and s[2] <= b for a, k, b in base)]
    return base, sorted({*base, *more})


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and all spans, of every row of ``docs`` (doc_id, text).

    Spans are in code points of the source, end exclusive. Null and empty texts have no spans; texts of any length
    are read whole; repeated rows are alike; an empty table gives no rows; other columns are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(t or "") for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64())
                      for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts,
                 pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([written(every) for _, every in found], pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
