"""Ways to read a value out of page text, as column functions.

Elements are addressed by patterns that match their markup: a rule names the
element's text with a regular expression, and its attributes and text content are
read from the match. Page HTML is rarely well-formed, so XML functions do not apply.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, functions as F

from tanadex.functions.text import blank_to_null, let, strip
from tanadex.functions.transforms import first_match, java_pattern

STRATEGIES: dict[str, Callable[[Column, dict], Column]] = {}

# Names of the character references of HTML; a no-break space is read as a space.
ENTITIES = {name[:-1]: char for name, char in html5.items() if name.endswith(";")} | {"nbsp": " "}
LAST_POINT, SURROGATES = 0x10FFFF, (0xD800, 0xDFFF)
# Patterns that begin so name a tag whose elements may hold each other.
NESTED = "nested:"
JSON_LD = (r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>")


def strategy(name: str):
    """Register a strategy under the name rules use for it."""
    def register(fn):
        STRATEGIES[name] = fn
        return fn
    return register


def _reference(names: Column):
    """Decode the reference that follows an ampersand; what is none keeps it."""
    def decode(piece: Column, i: Column) -> Column:
        decimal = F.nullif(F.regexp_extract(piece, r"^#0*(\d{1,7});", 1), F.lit(""))
        hexadecimal = F.nullif(F.regexp_extract(piece, r"^#[xX]0*([0-9A-Fa-f]{1,6});", 1), F.lit(""))
        point = F.coalesce(decimal.cast("bigint"), F.conv(hexadecimal, 16, 10).cast("bigint"))
        real = point.between(1, LAST_POINT) & ~point.between(*SURROGATES)
        char = F.when(real, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(
            F.try_element_at(names, F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*);", 1)))
        return (F.when(i == 0, piece).when(char.isNotNull(), F.concat(char, F.regexp_replace(piece, r"^[^;]*;", "")))
                .otherwise(F.concat(F.lit("&"), piece)))
    return decode


def decode_entities(col: Column) -> Column:
    """Numeric and named character references to their characters, once; unknown ones stay as written."""
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")  # folds to one constant
    return let(col, lambda raw: F.when(~raw.contains("&"), raw).otherwise(
        F.array_join(F.transform(F.split(raw, "&"), _reference(names)), "")))


def text_content(markup: Column) -> Column:
    """Text of an element: scripts, styles, comments and tags removed, entities decoded."""
    bare = F.regexp_replace(markup, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "")
    return decode_entities(F.regexp_replace(bare, r"<[^>]*>", ""))


def opening_tag(markup: Column) -> Column:
    return F.regexp_extract(markup, r"<[A-Za-z][^>]*>", 0)


def _tag_value(tag: Column, name: str) -> Column:
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    value = F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))
    return F.when(tag.rlike(pattern), decode_entities(value))


def attribute(markup: Column, name: str) -> Column:
    """Value of an attribute of the element's opening tag; null when absent."""
    return let(opening_tag(markup), lambda tag: _tag_value(tag, name))


def attribute_candidates(markup: Column, names) -> Column:
    """The first non-empty attribute; else the last one looked at, as it is."""
    names = list(names)
    return let(opening_tag(markup), lambda tag: F.coalesce(
        *[let(_tag_value(tag, n), blank_to_null) for n in names], _tag_value(tag, names[-1])))


def nested_elements(markup: Column, tag: str) -> Column:
    """``array<struct<at, level, markup>>`` of all whole elements of a tag, in order of their beginnings, level 0 outside.

    The markup is cut before every opening and closing tag of that name. Of the n-th opening tag, ``2 n`` less its place
    among all tags is the level; closing tags likewise. On one level both alternate, so in order of level and place an
    element ends with its neighbour. Nothing is read twice: the work is that of sorting the tags, however deep they lie.
    An element without an end is none, nor is an end without a beginning.
    """
    opening, closing = rf"(?i)^<{tag}(?=[\s/>])", rf"(?i)^</{tag}\s*>"
    pieces = F.split(markup, rf"(?i)(?=<{tag}[\s/>])|(?=</{tag}\s*>)", -1)
    kind = "struct<level:int,at:int,ends:boolean>"

    def walk(cut):
        tags = F.filter(F.transform(cut, lambda c, i: F.struct(
            i.alias("at"), F.when(c.rlike(opening), False).when(c.rlike(closing), True).alias("ends"))), lambda t: t["ends"].isNotNull())
        placed = F.transform(tags, lambda t, i: F.struct(t["at"].alias("at"), t["ends"].alias("ends"), i.alias("i")))
        begins = F.transform(F.filter(placed, lambda t: ~t["ends"]), lambda t, n: F.struct(
            (2 * n - t["i"]).alias("level"), t["at"].alias("at"), t["ends"].alias("ends")).cast(kind))
        ends = F.transform(F.filter(placed, lambda t: t["ends"]), lambda t, n: F.struct(
            (t["i"] - 2 * n - 1).alias("level"), t["at"].alias("at"), t["ends"].alias("ends")).cast(kind))

        def whole(order):
            pairs = F.transform(order, lambda t, j: let(F.get(order, j + 1), lambda e: F.when(
                ~t["ends"] & e["ends"] & (e["level"] == t["level"]), F.struct(t["at"].alias("at"), t["level"].alias("level"), F.concat(
                    F.array_join(F.slice(cut, t["at"] + 1, e["at"] - t["at"]), ""),
                    F.regexp_extract(F.get(cut, e["at"]), closing, 0)).alias("markup")))))
            return F.array_sort(F.array_compact(pairs))
        return let(F.array_sort(F.concat(begins, ends)), whole)
    return let(pieces, walk)


def _matches(markup: Column, pattern: str) -> Column:
    if pattern == ":root":
        return F.array(markup)
    if pattern.startswith(NESTED):
        tag, _, level = pattern.removeprefix(NESTED).partition("@")
        found = nested_elements(markup, tag)
        return F.transform(F.filter(found, lambda e: e["level"] == int(level)) if level else found, lambda e: e["markup"])
    return F.regexp_extract_all(markup, F.lit(java_pattern(pattern, "is")), F.lit(0))


def elements(markup: Column, patterns) -> Column:
    """Matches of the first pattern that has any; ``:root`` is the markup itself, ``nested:tag`` all whole elements of a
    tag, ``nested:tag@0`` those of one level."""
    found = [_matches(markup, p) for p in patterns]
    if len(found) == 1:
        return found[0]
    hits = F.filter(F.array(*found), lambda f: F.size(f) > 0)
    return F.coalesce(F.get(hits, F.lit(0)), F.array().cast("array<string>"))


@strategy("regex")
def regex_strategy(html: Column, config: dict) -> Column:
    """First match's group, stripped unless told otherwise; empty text is no value."""
    pattern = config.get("pattern")
    if not pattern:
        return F.lit(None).cast("string")
    found = let(first_match(html, pattern, int(config.get("group", 0)), config.get("flags")),
                blank_to_null)
    return strip(found) if config.get("strip", True) else found


def jsonld_block(html: Column) -> Column:
    """The first linked-data block that parses."""
    blocks = F.transform(F.regexp_extract_all(html, F.lit(JSON_LD), F.lit(1)), strip)
    return F.get(F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull()), F.lit(0))


def jsonld_value(block: Column, path: str | None) -> Column:
    """What a block has at a path; a path miss gives the whole block."""
    return F.coalesce(json_path(block, path), block) if path else block


@strategy("jsonld")
def jsonld_strategy(html: Column, config: dict) -> Column:
    """The first linked-data block that parses decides; for several paths of one page, take its block once."""
    path = config.get("path")
    return let(jsonld_block(html), lambda b: jsonld_value(b, path)) if path else jsonld_block(html)


def json_path(block: Column, path: str) -> Column:
    """Value at a dotted path; lists at the root, nested to any depth, are searched for their first hit."""
    steps = "$" + "".join(f"['{key}']" for key in path.split("."))

    def is_list(text):
        return text.rlike(r"^\s*\[")

    def opened(members, _):
        inner = F.flatten(F.transform(members, lambda m: F.when(is_list(m), F.coalesce(
            F.from_json(m, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(m))))
        return F.when(F.exists(members, is_list), F.filter(inner, lambda m: m.isNotNull())).otherwise(members)
    # No list lies deeper than there are opening brackets; rounds without a list left cost one look.
    rounds = F.greatest(F.length(F.regexp_replace(block, r"[^\[]", "")), F.lit(1))
    members = F.aggregate(F.sequence(F.lit(1), rounds), F.array(block).cast("array<string>"), opened)
    hits = F.filter(F.transform(members, lambda m: F.get_json_object(m, steps)), lambda v: v.isNotNull())
    return F.when(is_list(block), F.get(hits, F.lit(0))).otherwise(F.get_json_object(block, steps))


@strategy("tag")
def tag_strategy(html: Column, config: dict) -> Column:
    """Text or attribute of all elements a pattern matches, joined by one space."""
    pattern = config.get("pattern")
    if not pattern:
        return F.lit(None).cast("string")
    found = elements(html, [pattern])
    name = config.get("attribute")
    keep = config.get("strip", True)
    if name:
        values = F.transform(found, lambda e: attribute(e, name))
    else:
        values = F.transform(found, lambda e: strip(text_content(e)) if keep else text_content(e))
    values = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return let(F.array_join(values, " "), blank_to_null)
