"""Suggestions from an index of prefixes: built once, merged in parts, asked for many prefixes at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanadex.functions.text import let, strip, tokens
from tanadex.operators.scale import saved

SIZE = 5
# Fields of several names; a prefix may match their words, and those of brand, model and search text, each worth one point.
LIST_FIELDS = ("brand_aliases", "model_aliases")
# Ends a shortened word; no word holds it.
CUT = "\x00"
COLUMNS = ("cased", "prefix", "term", "score", "id", "pos")


def _line(text: Column) -> Column:
    """The words of a text, each after a space."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "))


def _shared(a: Column, b: Column) -> Column:
    """The length of the longest beginning that two texts share."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(a, k, F.lit(1)) != F.substring(b, k, F.lit(1)))
    return F.when(n > 0, F.coalesce(F.get(differ, F.lit(0)) - 1, n)).otherwise(0)


def _longest(value: Column, others: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(others, lambda o: _shared(value, o))), F.lit(0))


def _name_terms() -> Column:
    """Display terms with their places, without the number, which stands third."""
    terms = F.concat(F.array("brand_name", "model_name", F.lit(None).cast("string")), "brand_aliases", "model_aliases")
    return F.filter(F.transform(terms, lambda t, i: F.struct(i.alias("pos"), t.alias("term"))), lambda t: t["term"].isNotNull())


def _shapes(docs: DataFrame) -> DataFrame:
    """One row for all documents that give their name terms the same points, with the first of their ids.

    Prefixes of name terms ask for beginnings of their words. Of other words in ``search_text``, and of the number, only
    the beginning that they share with those words or terms can matter, so the rest is cut off and marked. Documents that
    differ in their numbers alone mostly fall together.
    """
    words = F.array_distinct(F.flatten(F.transform(F.filter(F.concat(F.array("brand_name", "model_name"), "brand_aliases", "model_aliases"),
                                                            lambda t: t.isNotNull()), tokens)))
    low = F.array_distinct(F.transform("names", lambda t: F.lower(t["term"])))
    rows = docs.withColumns({"words": words, "names": _name_terms(), "said": tokens("search_text")}).withColumn("low", low)

    def cut(word):
        return let(_longest(word, F.col("words")), lambda n: F.when(n == F.length(word), word).when(
            n > 0, F.concat(F.substring(word, F.lit(1), n), F.lit(CUT))).otherwise(CUT))
    said = F.transform("said", lambda w: F.when(F.array_contains("words", w), w).otherwise(cut(w)))
    number = F.coalesce("model_no", F.lit(""))
    # Letters beyond ASCII may change in length with their case; such numbers stay whole.
    begins = F.when(number.rlike(r"[^\x00-\x7F]"), number).otherwise(
        F.substring(number, F.lit(1), _longest(F.lower(number), F.col("low"))))
    keys = ["brand_name", "model_name", "brand_aliases", "model_aliases", "said", "number"]
    return (rows.withColumns({"said": F.concat(F.lit(" "), F.array_join(said, " ")), "number": begins})
            .groupBy(*keys).agg(F.min("id").alias("id")))


def _begun(rows: DataFrame, said: str, number: str) -> DataFrame:
    """The entries of rows with ``terms`` (pos, term), with a line for ``search_text`` and a number."""
    lists = [F.transform(F.coalesce(c, F.array().cast("array<string>")), _line) for c in LIST_FIELDS]
    fields = F.array(F.array(_line(F.col("brand_name"))), F.array(_line(F.col("model_name"))), F.array(said), *lists)
    rows = rows.select("id", F.col(number).alias("model_no"), fields.alias("fields"), F.inline("terms"))
    low = F.lower("term")
    ends = F.when(F.length(low) > 0, F.sequence(F.lit(1), F.length(low)))
    each = rows.withColumn("prefix", F.explode(F.transform(ends, lambda n: F.substring(low, F.lit(1), n))))
    # Prefixes are asked for without white space around them.
    each = each.where((F.col("prefix") != "") & (strip("prefix") == F.col("prefix")))
    asked = F.concat(F.lit(" "), F.array_join(tokens("prefix"), " "))
    points = F.size(F.filter("fields", lambda lines: F.exists(lines, lambda line: F.contains(line, F.col("asked")))))
    scored = each.withColumn("asked", asked).withColumn("points", F.when(F.col("asked") == " ", 0).otherwise(points))
    own = F.substring(F.coalesce("model_no", F.lit("")), F.lit(1), F.length("prefix"))
    spelled = F.when(F.lower(own) == F.col("prefix"), own)

    def kind(cased, prefix, score):
        return F.struct(F.lit(cased).alias("cased"), prefix.alias("prefix"), score.alias("score"))
    kinds = F.array(kind(False, F.col("prefix"), F.col("points")), kind(True, spelled, F.col("points") + 1))
    return (scored.select("id", "pos", "term", F.explode(kinds).alias("k"))
            .select("k.cased", "k.prefix", "term", "k.score", "id", "pos")
            .where(F.col("prefix").isNotNull() & (F.col("score") > 0)))


def prefix_entries(docs: DataFrame) -> DataFrame:
    """(cased, prefix, term, score, id, pos): each display term under each of its beginnings.

    A document scores one point for each field that holds the words of the prefix in a row, the last one as a
    beginning. Those points do not depend on case and stand under the lower-case prefix. One more point goes to numbers
    that begin with the prefix as it is written: entries with it stand under that spelling as well, marked ``cased``.
    Documents whose name terms score alike give one entry for each of them, under the first id; numbers give their own.
    """
    names = _shapes(docs).withColumn("terms", _name_terms())
    numbers = docs.where(F.col("model_no") != "").withColumns({
        "terms": F.array(F.struct(F.lit(2).alias("pos"), F.col("model_no").alias("term"))), "said": _line(F.col("search_text"))})
    return _begun(names, "said", "number").unionByName(_begun(numbers, "said", "model_no"))


def _first_terms(entries: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The best entry of each term under a key, and of these the first ``size``; both are cut before the shuffle."""
    best = F.min(F.struct((-F.col("score")).alias("neg"), "id", "pos")).alias("best")
    firsts = entries.groupBy(*keys, "term").agg(best)
    place = F.row_number().over(W.partitionBy(*keys).orderBy("best"))
    return firsts.withColumn("place", place).where(F.col("place") <= size).select(
        *keys, "term", (-F.col("best.neg")).alias("score"), "best.id", "best.pos", "place")


def prefix_index(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The first ``size`` terms of every prefix, by spelling; see ``prefix_entries``. Pages of up to ``size`` are exact."""
    return _first_terms(prefix_entries(docs), ["cased", "prefix"], size).select(*COLUMNS)


def merge_indexes(parts: list[DataFrame], size: int = SIZE) -> DataFrame:
    """One index of indexes over parts of the documents, each built with the same ``size`` or a larger one."""
    return _first_terms(reduce(DataFrame.unionByName, parts), ["cased", "prefix"], size).select(*COLUMNS)


def suggest_batch(index: DataFrame, prefixes: DataFrame, size: int = SIZE) -> DataFrame:
    """(prefix, place, term) for a table of prefixes, from the index alone.

    A term's place goes by its best document, by points, id and field. Entries under the lower-case prefix hold the
    points that every spelling earns, cased ones the points of this spelling; the better entry of a term counts.
    Blank prefixes have no suggestions; a prefix that is asked for twice is answered once.
    """
    asked = prefixes.select("prefix").distinct().withColumn("text", strip("prefix")).where(F.col("text") != "")
    looked = asked.select("prefix", F.explode(F.array(
        F.struct(F.lit(False).alias("cased"), F.lower("text").alias("key")),
        F.struct(F.lit(True).alias("cased"), F.col("text").alias("key")))).alias("k")).select("prefix", "k.cased", "k.key")
    entries = index.withColumnRenamed("prefix", "key")
    return _first_terms(looked.join(entries, ["cased", "key"]), ["prefix"], size).select("prefix", "place", "term")


def stored_index(docs: DataFrame, size: int = SIZE) -> DataFrame:
    return saved(prefix_index(docs, size))
