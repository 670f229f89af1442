"""Text columns: Unicode whitespace, name folding, language, search tokens."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# White space as Python's str.strip() sees it, which is the Unicode
# property plus the four separators U+001C..U+001F.
SPACE = r"[\s\x1c-\x1f]"
SPACES = rf"(?U){SPACE}+"

# Punctuation dropped before names are compared.
DROPPED = ",.・。、，·•‧∙"
# Symbol variants that compatibility normalisation leaves alone.
SYMBOLS = {
    "⅋": "&",
    "–": "-",
    "—": "-",
    "―": "-",
    "−": "-",
    "‘": "'",
    "’": "'",
    "“": '"',
    "”": '"',
}

HAN = r"[一-鿿]"
KANA = r"[぀-ヿ]"

# One token per Han or Hiragana character, per Katakana run, per run of letters or
# digits of the other scripts. Plain letters and digits are taken first: looking the
# scripts of a character up costs far more, and no token depends on the order.
_LETTERS = r"[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]]"
TOKEN = (rf"[a-z0-9]++{_LETTERS}*+|{_LETTERS}++"
         r"|[\p{IsHan}\p{IsHiragana}]|[\p{IsKatakana}ー]+")


def text_column(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``fn``, which may use it many times."""
    return F.transform(F.array(value), fn)[0]


def strip(col) -> Column:
    """Trim Unicode white space (``F.trim`` removes only U+0020)."""
    return F.regexp_replace(text_column(col), rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def blank_to_null(col) -> Column:
    return F.nullif(text_column(col), F.lit(""))


def is_blank(col) -> Column:
    return F.coalesce(strip(col), F.lit("")) == ""


def squeeze(col) -> Column:
    """Runs of white space become one space; ends trimmed."""
    return strip(F.regexp_replace(text_column(col), SPACES, " "))


_DROP_PATTERN = re.compile(rf"[\s{re.escape(DROPPED)}]")
_SYMBOL_TABLE = str.maketrans(SYMBOLS)


def fold_name(value: str) -> str:
    """Reference form of a name for matching, for one Python string."""
    decoded = unicodedata.normalize("NFKC", html.unescape(value))
    return _DROP_PATTERN.sub("", decoded.translate(_SYMBOL_TABLE))


@F.pandas_udf(T.StringType())
def _fold_names(values: pd.Series) -> pd.Series:
    known = {v: fold_name(v) for v in values.dropna().unique()}
    return values.map(known, na_action="ignore").astype(object)


def _needs_decoding(col: Column) -> Column:
    return col.rlike(r"[^\x00-\x7F]|&")


def normalize_text(col) -> Column:
    """Name form for matching: entities decoded, NFKC, symbols unified, separators gone.

    Spark has no NFKC, so text with a non-ASCII character or an entity goes through
    one Arrow batch function; plain ASCII, the bulk of the data, stays in the JVM
    and reaches Python only as null.
    """
    col = text_column(col)
    odd = _needs_decoding(col)
    plain = F.regexp_replace(col, rf"[\s\x1c-\x1f{re.escape(DROPPED)}]", "")
    folded = _fold_names(F.when(odd, col))
    return F.coalesce(F.when(odd, folded).otherwise(plain), F.lit(""))


def match_key(col) -> Column:
    return F.lower(normalize_text(col))


def lower_key(col) -> Column:
    return strip(F.lower(text_column(col)))


def normalize_model_no(col) -> Column:
    """No white space, upper case, empty for null."""
    return F.upper(F.regexp_replace(F.coalesce(text_column(col), F.lit("")), SPACES, ""))


def detect_language(col) -> Column:
    """zh when any Han character, else ja when any kana, else en."""
    col = text_column(col)
    return (F.when(col.rlike(HAN), "zh").when(col.rlike(KANA), "ja").otherwise("en"))


def product_language(brand, model) -> Column:
    parts = [F.nullif(strip(c), F.lit("")) for c in (brand, model)]
    return detect_language(F.concat_ws(" ", *parts))


def needs_translation(col, lang) -> Column:
    """False for empty text, otherwise whether its language differs from ``lang``."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    present = F.coalesce(text_column(col), F.lit("")) != ""
    return present & (detect_language(col) != lang)


def has_kana(col) -> Column:
    return text_column(col).rlike(KANA)


def has_han(col) -> Column:
    return text_column(col).rlike(HAN)


def tokens(col) -> Column:
    """Lower-case search tokens in order, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text_column(col), F.lit(""))),
                                F.lit(TOKEN), F.lit(0))


def term_counts(token_array: Column) -> Column:
    """``array<struct<term,tf>>`` of a token array, without leaving the row.

    Sorted run lengths: linear after the sort, whatever the text length.
    """
    ordered = F.array_sort(token_array)
    return F.transform(
        F.array(ordered),
        lambda s: F.transform(
            F.array(F.filter(
                F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1))
                .otherwise(F.array().cast("array<int>")),
                lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))),
            lambda starts: F.transform(
                starts,
                lambda at, j: F.struct(
                    F.get(s, at).alias("term"),
                    (F.coalesce(F.get(starts, j + 1), F.size(s)) - at)
                    .cast("bigint").alias("tf"))))[0])[0]
