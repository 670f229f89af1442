"""Value transforms that extraction rules may list, as column functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from tanadex.functions.text import SPACE, let, strip

TRANSFORMS: dict[str, Callable[[Column, dict], Column]] = {}


def transform(name: str):
    """Register a transform under the name rules use for it."""
    def register(fn):
        TRANSFORMS[name] = fn
        return fn
    return register


def java_pattern(pattern: str, flags: str | None = "") -> str:
    """A Python-style pattern for the JVM: Unicode classes on, i/m/s flags inlined."""
    letters = "".join(sorted({c for c in (flags or "").lower() if c in "ims"}))
    return f"(?U{letters})" + (pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z"))


def group_count(pattern: str) -> int:
    """Number of capturing groups of a pattern."""
    import re
    return re.compile(pattern).groups


def first_match(col: Column, pattern: str, group: int = 0, flags: str | None = "") -> Column:
    """The group of the first match, null without one; a missing group means all of it."""
    compiled = java_pattern(pattern, flags)
    index = group if group <= group_count(pattern) else 0
    return F.when(col.rlike(compiled), F.regexp_extract(col, compiled, index))


def apply_transforms(col: Column, specs) -> Column:
    """Left to right; null stays null; an unknown type changes nothing."""
    def step(value, spec):
        spec = dict(spec)
        fn = TRANSFORMS.get(spec.get("type"))
        if fn is None:
            return value
        config = spec.get("config")
        return let(value, lambda v: fn(v, config if config is not None else spec))
    return reduce(step, specs or [], col)


@transform("strip")
def _strip(col, config=None):
    return strip(col)


@transform("regex_capture")
def _regex_capture(col, config):
    pattern = config.get("pattern")
    if not pattern:
        return col
    found = first_match(col, pattern, int(config.get("group", 1)), config.get("flags"))
    return F.when(col == "", col).otherwise(found)


@transform("replace")
def _replace(col, config):
    source = config.get("from")
    if source is None:
        return col
    return F.replace(col, F.lit(source), F.lit(config.get("to", "")))


@transform("to_int")
def _to_int(col, config=None):
    digits = F.regexp_replace(col.cast("string"), rf"(?U)[,\s\x1c-\x1f]", "")
    return F.when(digits.rlike(r"^[+-]?\d+$"), digits.try_cast("bigint")).cast("string")


@transform("url_join")
def _url_join(col, config):
    """Absolute URLs stay; the rest resolves against the base (RFC 3986)."""
    base = config.get("base") or ""
    if not base:
        return col
    scheme, root, folder, document, whole = _base_parts(base)
    path = F.regexp_replace(col, r"[?#].*$", "")
    tail = F.regexp_extract(col, r"([?#].*)$", 1)
    rooted = F.when(col.startswith("/"), path).otherwise(F.concat(F.lit(folder), path))
    return (F.when((col == "") | col.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), col)
            .when(col.startswith("//"), F.concat(F.lit(scheme + ":"), col))
            .when(col.startswith("?"), F.concat(F.lit(document), col))
            .when(col.startswith("#"), F.concat(F.lit(whole), col))
            .otherwise(F.concat(F.lit(root), let(rooted, _without_dots), tail)))


def _base_parts(base: str):
    from urllib.parse import urlsplit
    parts = urlsplit(base)
    root = f"{parts.scheme}://{parts.netloc}"
    folder = parts.path.rsplit("/", 1)[0] + "/" if "/" in parts.path else "/"
    return parts.scheme, root, folder, root + parts.path, base.split("#", 1)[0]


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a rooted path."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    resolved = F.concat(F.lit("/"), F.array_join(closed, "/"))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), resolved).otherwise(path)


@transform("pick_best_srcset")
def _pick_best_srcset(col, config=None):
    """Widest candidate of an image set; the first one wins a tie."""
    def candidate(entry, pos):
        words = F.split(strip(entry), rf"(?U){SPACE}+")
        widths = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
                             lambda w: F.regexp_replace(w, "[xw]+$", ""))
        widest = F.array_max(F.transform(
            F.filter(widths, lambda w: w.rlike(r"^[+-]?\d+$")), lambda w: w.try_cast("bigint")))
        return F.struct(F.greatest(F.coalesce(widest, F.lit(0)), F.lit(0)).alias("width"),
                        (-pos).alias("rank"), words[0].alias("url"))
    entries = F.filter(F.transform(F.split(col, ","), candidate), lambda c: c["url"] != "")
    best = F.array_max(entries)["url"]
    return (F.when(~col.contains(",") & ~col.contains(" "), col)
            .otherwise(F.coalesce(best, col)))
