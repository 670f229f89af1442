"""Listing titles split into brand, model and model number by an alias dictionary.

Aliases are looked up, never scanned: a table of the lengths that aliases with a given beginning have turns each place
of a title into a few keys, each key meets the aliases by equality, and one aggregate keeps the best hit of a title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanadex.functions.text import let, match_key, squeeze, strip
from tanadex.model import DEFAULT_CATEGORY
from tanadex.operators.scale import saved
from tanadex.sources.dictionary import AliasDictionary
from tanadex.sources.rules import Profile

# Words after which a title holds no names, and trailing audience words.
CUT_WORDS = ("腕時計", "ウォッチ", "時計")
AUDIENCE_WORDS = ("メンズ", "レディース", "ユニセックス", "男女兼用", "ボーイズ", "ガールズ")
# Fixed value: what a model number looks like.
MODEL_NUMBER = r"^(?=.*[0-9])[A-Za-z0-9./-]{3,}$"
# A title with fewer words than its alias is cut so many characters beyond the alias's length, and ends
# at the most preferred break from so many characters before that length on.
CUT_BEYOND, CUT_BEFORE = 10, 5
BREAKS = (" ", "　", "・", ".", ",")
# The title transform of extraction rules, and the fields that it adds to an item.
RULE = "split_watch_title"
NAME_FIELDS = ("brand_name", "model_name", "model_no")

KEY = ["title_category", "clean_title"]
MET = ["title_category", "brand_found", "form"]
# How an alias meets a title: at its beginning, from the beginning of a word to the end of a word, or folded.
AT_START, AT_WORDS, FOLDED = "start", "words", "folded"
# Characters of a key by which the lengths of keys are looked up.
LEAD = 2
# Hits of one length that a rank has room for.
LENGTH_RANKS = 1 << 40


def clean_title(title: Column) -> Column:
    bare = F.replace(F.regexp_replace(strip(title), "【[^】]*】", " "), F.lit("　"), F.lit(" "))
    return squeeze(F.split(bare, "|".join(CUT_WORDS), 2)[0])


def _words(col: Column) -> Column:
    return F.filter(F.split(col, " "), lambda t: t != "")


def alias_entries(dictionary: AliasDictionary) -> DataFrame:
    """Every alias under each key by which a title can meet it, with the hit that it gives.

    ``brand_found`` is empty for aliases of brands. Of the hits of a title the least is the best: the longest alias,
    then dictionary order. ``rank`` numbers the hits of a brand in that order, so that a title compares plain numbers.
    ``anywhere`` marks keys that also count behind a title's first character.
    """
    rows = dictionary.rows.where(strip("alias") != "").withColumn("joined", F.array_join(_words(F.col("alias")), " "))
    is_brand = F.col("model").isNull()

    def form(name, key, text, anywhere, prefer):
        return F.struct(F.lit(name).alias("form"), key.alias("key"), text.alias("text"), anywhere.alias("anywhere"),
                        prefer.alias("prefer"))
    forms = F.array(form(AT_START, F.col("alias"), F.col("alias"), F.lit(False), F.when(is_brand, 1).otherwise(0)),
                    form(AT_WORDS, F.concat("joined", F.lit(" ")), F.col("joined"), ~is_brand & (F.col("joined") == F.col("alias")),
                         F.when(is_brand, 0).otherwise(1)),
                    form(FOLDED, match_key("alias"), F.col("alias"), ~is_brand, F.lit(0)))
    hit = F.struct((-F.length("alias")).alias("neg_len"), F.coalesce("model_ord", "brand_ord").alias("ord"), "alias_ord",
                   F.col("f.prefer").alias("prefer"), F.col("f.text").alias("text"), F.size(_words(F.col("alias"))).alias("n"))
    entries = rows.withColumn("f", F.explode(forms)).where(F.col("f.key") != "").select(
        F.col("category").alias("title_category"), F.when(is_brand, "").otherwise(F.col("brand")).alias("brand_found"), "f.form",
        F.substring("f.key", 1, LEAD).alias("lead"), "f.key", "f.anywhere", hit.alias("hit"))
    nth = F.row_number().over(W.partitionBy("title_category", "brand_found", "hit.neg_len").orderBy("hit"))
    return entries.withColumn("rank", F.col("hit.neg_len") * F.lit(LENGTH_RANKS) + nth)


def key_lengths(entries: DataFrame) -> DataFrame:
    """The lengths of the keys with each lead: few, however many aliases share it."""
    return entries.groupBy(*MET, "lead").agg(F.array_sort(F.collect_set(F.length("key"))).alias("lengths"))


def _best_hit(titles: DataFrame, entries: DataFrame, lengths: DataFrame, name: str,
              forms: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Add ``name``: the best entry that begins at one of the given places of a text, null where none does.

    ``forms`` has for each form the text and the array of places (from 1). A place looks its lead up and gets the
    lengths that keys with this lead have; only stretches of these lengths are looked up among the keys. What is gathered
    for a title is the least rank, and its hit is looked up after that.
    """
    form = F.array(*[F.struct(F.lit(f).alias("form"), text.alias("text"), places.alias("places"))
                     for f, (text, places) in forms.items()])
    each = titles.select("*", F.posexplode(form).alias("p0", "f")).select(
        *titles.columns, "p0", "f.form", "f.text", F.posexplode_outer("f.places").alias("p1", "at"))
    leads = F.array_distinct(F.array(*[F.substring("text", F.col("at"), F.lit(k)) for k in range(LEAD, 0, -1)]))
    each = each.select("*", F.posexplode_outer(leads).alias("p2", "lead")).join(lengths, [*MET, "lead"], "left")
    # A title keeps one row besides its hits.
    first = F.coalesce("p1", F.lit(0)) + F.coalesce("p2", F.lit(0)) + F.col("p0") == 0
    each = each.where(F.col("lengths").isNotNull() | first)
    inside = F.filter("lengths", lambda k: F.col("at") + k - 1 <= F.length("text"))
    each = each.select("*", F.posexplode_outer(inside).alias("p3", "size")).withColumn(
        "key", F.substring("text", F.col("at"), F.col("size")))
    fits = each.join(entries.drop("hit"), [*MET, "lead", "key"], "left").withColumn(
        "rank", F.when(F.col("anywhere") | (F.col("at") == 1), F.col("rank")))
    best = fits.where(F.col("rank").isNotNull() | first & (F.coalesce("p3", F.lit(0)) == 0)).groupBy(*titles.columns).agg(F.min("rank").alias("rank"))
    of = ["title_category", "brand_found", "rank"]
    return best.join(entries.select(*of, F.col("hit").alias(name)), of, "left").select(*titles.columns, name)


def _cut(text: Column, alias: Column) -> Column:
    """A cut of about the alias's length, for a text with fewer words than the alias."""
    size = F.length(alias)

    def ended(cut):
        start = F.when(size >= CUT_BEFORE, size - CUT_BEFORE).otherwise(F.greatest(F.length(cut) + size - CUT_BEFORE, F.lit(0)))
        ends = F.transform(F.split(cut, ""), lambda c, i: F.when((i >= start) & (i > 0), F.struct(
            F.nullif(F.array_position(F.array(*map(F.lit, BREAKS)), c), F.lit(0)).alias("order"), i.alias("i"))))
        end = F.array_min(F.filter(ends, lambda e: e["order"].isNotNull()))["i"]
        return F.coalesce(strip(F.substring(cut, F.lit(1), end)), cut)

    return let(let(strip(F.substring(text, F.lit(1), size + CUT_BEYOND)), ended), lambda cut: F.coalesce(F.nullif(cut, F.lit("")), alias))


def _named(exact: str, near: str, words: Column, text: Column) -> tuple[Column, Column]:
    """What the title says for the best hit, and how many words that takes: a folded hit takes as many words as its
    alias has, or a cut of a shorter title."""
    hit, folded = F.col(exact), F.col(near)
    whole = (folded["n"] > 0) & (F.size(words) >= folded["n"])
    stands = F.when(whole, F.array_join(F.slice(words, F.lit(1), F.greatest(folded["n"], F.lit(1))), " ")).otherwise(
        _cut(text, folded["text"]))
    used = F.when(F.coalesce(hit, folded).isNotNull(), F.greatest(F.coalesce(hit["n"], folded["n"]), F.lit(1))).otherwise(0)
    return F.when(hit.isNotNull(), hit["text"]).when(folded.isNotNull(), stands), used


def _after(words: Column, n: Column) -> Column:
    return F.slice(words, n + 1, F.greatest(F.size(words), F.lit(1)))


def _gathered(titles: DataFrame) -> DataFrame:
    """Titles in as many tasks as the session has for a shuffle, whatever their bytes: every step that follows works on
    them in place, until a function outside the engine has run, which hides where they lie."""
    return titles.repartition(int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)


def _every(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text)))


def title_names(titles: DataFrame, dictionary: AliasDictionary, audience=AUDIENCE_WORDS) -> DataFrame:
    """(title_category, clean_title) with brand_name, model_name and model_no; each title once, none of them blank."""
    entries = dictionary.small("title_entries", lambda: alias_entries(dictionary))
    lengths = dictionary.small("title_lengths", lambda: key_lengths(entries))
    suffix, start = "|".join(audience), F.array(F.lit(1))
    line = F.regexp_replace("clean_title", rf"(?:(?:^| )(?:{suffix}))+$", "")
    named = titles.select(*KEY, line.alias("line"), F.lit("").alias("brand_found")).where(F.col("line") != "")
    named = _best_hit(named, entries, lengths, "exact", {
        AT_START: (F.col("clean_title"), start), AT_WORDS: (F.concat("line", F.lit(" ")), start)})
    missed = named.withColumn("folded", match_key(F.when(F.col("exact").isNull(), F.col("clean_title"))))
    named = _best_hit(_gathered(missed), entries, lengths, "near", {FOLDED: (F.col("folded"), F.when(F.col("folded") != "", start))})
    words = _words(F.col("line"))
    brand, used = _named("exact", "near", words, F.col("clean_title"))
    known = dictionary.brand_lookup("exact").select(
        F.col("category").alias("title_category"), F.col("key_exact").alias("brand_name"), F.col("brand_exact").alias("brand_found"))
    named = (named.select(*KEY, F.coalesce(brand, F.get(words, F.lit(0))).alias("brand_name"),
                          F.array_join(_after(words, used), " ").alias("rest"))
             .join(known, ["title_category", "brand_name"], "left"))
    begins = F.transform(F.split(F.concat(F.lit(" "), "rest"), ""), lambda c, i: F.when(c == " ", i + 1))
    named = _best_hit(named, entries, lengths, "exact", {
        AT_START: (F.col("rest"), start), AT_WORDS: (F.concat("rest", F.lit(" ")), F.array_compact(begins))})
    missed = named.withColumn("folded", match_key(F.when(F.col("exact").isNull() & F.col("brand_found").isNotNull(), F.col("rest"))))
    named = _best_hit(_gathered(missed), entries, lengths, "near", {FOLDED: (F.col("folded"), _every(F.col("folded")))})
    words = _words(F.col("rest"))
    model, used = _named("exact", "near", words, F.col("rest"))
    # As many leading words are dropped as the alias has, wherever it was found.
    named = named.select(*KEY, "brand_name", model.alias("model_found"), _after(words, used).alias("words"))
    numbers = F.array_compact(F.transform("words", lambda w, i: F.when(w.rlike(MODEL_NUMBER), i)))
    named = named.withColumn("no_at", F.get(numbers, F.size(numbers) - 1))
    left = F.array_join(F.filter("words", lambda w, i: ~i.eqNullSafe(F.col("no_at"))), " ")
    return named.select(*KEY, F.nullif("brand_name", F.lit("")).alias("brand_name"),
                        F.coalesce("model_found", F.nullif(left, F.lit(""))).alias("model_name"),
                        F.get("words", F.col("no_at")).alias("model_no"))


def split_titles(items: DataFrame, dictionary: AliasDictionary, title: str = "title",
                 audience=AUDIENCE_WORDS) -> DataFrame:
    """Add clean_title, brand_name, model_name and model_no (null where not found).

    Each distinct title is cleaned and split once, whatever the number of its items, and joined back to them. Items without
    a category are split by the dictionary of the default one if there is no such column, else by none.
    """
    kept = [c for c in items.columns if c not in (*NAME_FIELDS, "clean_title")]
    category = F.coalesce("category", F.lit("")) if "category" in kept else F.lit(DEFAULT_CATEGORY)
    rows = items.select(*kept, category.alias("title_category"), F.col(title).alias("said"))
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = rows.select("title_category", "said").distinct().repartition(tasks, "title_category", "said")
    cleaned = saved(said.select("*", clean_title(F.col("said")).alias("clean_title")))
    distinct = _gathered(cleaned.select(*KEY).where(F.col("clean_title") != "")).distinct()
    split = cleaned.join(title_names(distinct, dictionary, audience), KEY, "left")
    return rows.join(split, ["title_category", "said"], "left").select(*kept, "clean_title", *NAME_FIELDS)


def split_title_fields(items: DataFrame, profiles: list[Profile], dictionary: AliasDictionary) -> DataFrame:
    """Item maps with the title transform of their profile's rules carried out.

    ``items`` are exploded items (profile, item). A field whose rule lists the transform keeps the clean title; brand,
    model and model number found in it become fields of the item, in place of such fields that it had. Items of other
    profiles, or without a value in the field, stay as they are.
    """
    field = F.lit(None).cast("string")
    for p in profiles:
        named = [n for n, rule in p.fields.items() if any(t.get("type") == RULE for t in rule.transforms)]
        field = F.when(F.col("profile") == p.name, F.lit(named[0])).otherwise(field) if named else field
    config = [t for p in profiles for rule in p.fields.values() for t in rule.transforms if t.get("type") == RULE]
    audience = next((t["suffix_tokens"] for t in config if t.get("suffix_tokens")), AUDIENCE_WORDS)
    category = F.coalesce(F.nullif(F.try_element_at("item", F.lit("category")), F.lit("")), F.lit(DEFAULT_CATEGORY))
    wide = items.select(F.struct("*").alias("row"), field.alias("field"), F.try_element_at("item", field).alias("title"),
                        category.alias("category"))
    split = split_titles(wide, dictionary, audience=tuple(audience))
    found = F.map_filter(F.create_map(*[e for n in NAME_FIELDS for e in (F.lit(n), F.col(n))]), lambda _, v: v.isNotNull())
    found = F.map_filter(found, lambda k, _: k != F.col("field"))
    own = F.map_filter("row.item", lambda k, _: (k != F.col("field")) & ~F.map_contains_key(found, k))
    item = F.when(F.coalesce("clean_title", F.lit("")) == "", F.col("row.item")).otherwise(
        F.map_concat(own, F.create_map("field", "clean_title"), found))
    return split.select(*[item.alias(c) if c == "item" else F.col(f"row.`{c}`").alias(c) for c in items.columns])
