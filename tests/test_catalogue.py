"""Names, products, translations, titles and search on a small multilingual dictionary."""

import datetime as dt
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tanadex.functions import text
from tanadex.operators import names, prefixes, products, search, titles, translate
from tanadex.operators.scale import saved
from tanadex.sources import rules
from tanadex.sources.dictionary import AliasDictionary

CONFIG = {
    "Rolex": {"aliases": ["ロレックス", "ROLEX", "劳力士"], "model_name": {
        "Daytona": {"aliases": ["デイトナ", "Cosmograph Daytona", "迪通拿"]},
        "GMT-Master II": {"aliases": ["GMTマスターII", "格林尼治II"]}}},
    "Audemars Piguet": {"aliases": ["オーデマ ピゲ", "爱彼", "AP"], "model_name": {
        "Royal Oak": {"aliases": ["ロイヤル オーク", "皇家橡树"]}}},
    "Hermès": {"aliases": ["エルメス", "爱马仕"], "model_name": {"H08": {"aliases": ["H08"]}}},
    "A. Lange & Söhne": {"aliases": ["朗格", "Lange"], "model_name": {"1815": {"aliases": ["1815系列"]}}},
    "Odd": "not a mapping",
}


@pytest.fixture(scope="module")
def dictionary(spark):
    return AliasDictionary(saved(AliasDictionary.from_config(spark, CONFIG).rows))


@pytest.fixture(params=["broadcast", "shuffle"])
def any_dictionary(spark, request):
    """The size of a table decides how it is joined; with a limit of -1 nothing is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if request.param == "shuffle":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield AliasDictionary.from_config(spark, CONFIG)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


ITEMS = [
    (1, "watch", "ロレックス", "デイトナ", "116 500ln", 100),
    (2, "watch", "rolex ", "DAYTONA", "116500LN", 90),
    (3, "watch", "爱彼", "皇家橡树", "15202", None),
    (4, "watch", "爱马仕", "H08", "H08.1", 50),
    (5, "watch", "A. Lange &amp; Söhne", "1815", "233", 70),
    (6, "watch", "朗格", "1815系列", None, 60),
    (7, "bag", "ロレックス", "x", "y", 5),
    (8, "watch", "Rolex", "格林尼治II", "126710", 40),
    (9, "watch", "オーデマピゲ", "ロイヤルオーク", "15500", 30),
]


@pytest.fixture(scope="module")
def items(spark):
    frame = spark.createDataFrame(ITEMS, "id long, category string, brand_name string, model_name string, "
                                         "model_no string, price long")
    day = F.expr("date_add(date'2024-01-01', cast(id as int))")
    return saved(frame.withColumns({
        "currency": F.lit("JPY"), "site": F.lit("s"), "status": F.lit("active"), "last_seen_dt": day,
        "image_thumb_300_key": F.lit(None).cast("string"), "product_url": F.lit("u"),
        "created_at": day.cast("timestamp"), "updated_at": day.cast("timestamp"),
        "product_id": F.lit(None).cast("long")}))


def test_canonical_names(items, any_dictionary):
    got = {r.id: (r.brand_std, r.model_std, r.model_no_std)
           for r in names.normalize_items(items, any_dictionary).collect()}
    assert got == {
        1: ("Rolex", "Daytona", "116500LN"), 2: ("Rolex", "Daytona", "116500LN"),
        3: ("Audemars Piguet", "Royal Oak", "15202"), 4: ("Hermès", "H08", "H08.1"),
        5: ("A. Lange & Söhne", "1815", "233"), 6: ("A. Lange & Söhne", "1815", ""),
        7: ("ロレックス", "x", "Y"), 8: ("Rolex", "GMT-Master II", "126710"),
        9: ("Audemars Piguet", "Royal Oak", "15500")}


def test_products(spark, items, dictionary):
    found, links = products.aggregate_items(items, dictionary)
    assert {(r.id, r.brand_name) for r in found.collect()} == {
        (1, "Rolex"), (2, "Audemars Piguet"), (3, "Hermès"), (4, "A. Lange & Söhne"), (5, "ロレックス"), (6, "Rolex"),
        (7, "Audemars Piguet")}
    assert {r.id: r.product_id for r in links.collect()} == {1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 7: 5, 8: 6, 9: 7}
    known = spark.createDataFrame([(40, "watch", "Rolex", "Daytona", "116500LN")],
                                  "id long, category string, brand_name string, model_name string, model_no string")
    again, links = products.aggregate_items(items, dictionary, known, limit=3)
    assert {r.id for r in again.collect()} == {40, 41}
    assert {r.id: r.product_id for r in links.collect()} == {1: 40, 2: 40, 3: 41}
    assert products.aggregate_item(items, 4, dictionary, known).collect()[0].product_id == 41
    assert tuple(products.product_stats(items, dictionary).first()) == (9, 8, 0, 1)


def test_translations(items, dictionary):
    brands, models = translate.brand_translations(dictionary), translate.model_translations(dictionary)
    rolex = brands.where("brand_name = 'Rolex'").first().translations
    assert (rolex.en, rolex.zh, rolex.ja, rolex.en_variants) == ("Rolex", "劳力士", "ロレックス", None)
    piguet = brands.where("brand_name = 'Audemars Piguet'").first().translations
    assert piguet.en_variants == ["AP"]
    shown = {r.id: (r.brand_name_translated, r.model_name_translated) for r in
             translate.translate_listing(items, dictionary, brands, models, "ja").collect()}
    assert shown[1] == (None, None)          # already Japanese
    assert shown[3] == ("オーデマ ピゲ", "ロイヤル オーク")
    assert shown[4] == ("エルメス", None)
    always = translate.translate_listing(items, dictionary, brands, models, "ja", only_if_different=False)
    assert {r.id: r.model_name_translated for r in always.collect()}[4] == "H08"
    english = translate.translate_listing(items, dictionary, brands, models, "en", only_if_different=False)
    assert english.where("brand_name_translated is not null").count() == 0
    nothing = brands.where("false")
    by_dictionary = translate.translate_names(names.normalize_items(items, dictionary), dictionary, nothing,
                                              models.where("false"), "ja")
    assert {r.id: r.brand_translated for r in by_dictionary.collect()}[4] == "エルメス"


TITLES = [
    ("【中古】ロレックス　デイトナ 116500LN 腕時計 メンズ", "ロレックス", "デイトナ", "116500LN"),
    ("Rolex Cosmograph Daytona 116500LN メンズ", "Rolex", "Cosmograph Daytona", "116500LN"),
    # a model found in mid-title drops the leading words, not its own
    ("Rolex Blue Daytona 16520", "Rolex", "Daytona", "16520"),
    # no brand: the first word is the brand and stays in the model
    ("Unknown Model 12345", "Unknown", "Unknown Model", "12345"),
    # a brand matched after folding takes as many words as its alias has
    ("オーデマピゲ ロイヤルオーク 15202IP.OO", "オーデマピゲ ロイヤルオーク", None, "15202IP.OO"),
    # with too few words it takes a cut of the title, up to a break
    ("オーデマピゲ", "オーデマピゲ", None, None),
    ("オーデマ・ピゲ", "オーデマ", None, None),
    ("ROLEXデイトナ 116500", "ROLEX", None, "116500"),
    ("a.lange&söhne 1815 X1", "a.lange&söhne", None, None),
    ("メンズ レディース", None, None, None),
    ("", None, None, None),
]


def test_titles(spark, any_dictionary):
    frame = spark.createDataFrame([(t[0],) for t in TITLES], "title string")
    got = {r.title: (r.brand_name, r.model_name, r.model_no)
           for r in titles.split_titles(frame, any_dictionary).collect()}
    assert got == {t[0]: t[1:] for t in TITLES}


def plain_split(title, config, category="watch"):
    """The split by scanning every alias, longest first: what the lookups must give for titles of clean words."""
    words = re.sub(" +", " ", re.split("腕時計|ウォッチ|時計", re.sub("【[^】]*】", " ", title).replace("　", " "))[0]).strip().split(" ")
    while words and words[-1] in titles.AUDIENCE_WORDS:
        words.pop()
    by_length = lambda names: sorted(names, key=lambda a: -len(a))
    fold = lambda x: text.fold_name(x).lower()

    def find(line, aliases, inner):
        for a in by_length(aliases):
            if line.startswith(a) or inner and f" {a} " in f" {line} ":
                return a, len(a.split(" "))
        for a in by_length(aliases):
            if (fold(a) in fold(line)) if inner else fold(line).startswith(fold(a)):
                n = len(a.split(" "))
                return " ".join(line.split(" ")[:n]), n
        return None, 0
    brand, n = find(" ".join(words), [a for b, d in config.items() for a in [b, *d["aliases"]]], False)
    brand, words = brand or words[0], words[n:]
    own = next((d for b, d in config.items() if brand in [b, *d["aliases"]]), {"model_name": {}})
    model, n = find(" ".join(words), [a for m, d in own["model_name"].items() for a in [m, *d["aliases"]]], True)
    words = words[n:]
    at = max((k for k, w in enumerate(words) if re.search(titles.MODEL_NUMBER, w)), default=None)
    number = words.pop(at) if at is not None else None
    return brand, model or " ".join(words) or None, number


def test_titles_against_a_scan_of_all_aliases(spark):
    rng = random.Random(8)
    part = lambda: rng.choice(["ロレ", "ックス", "day", "TONA", "15", "b-c", "x"])
    name = lambda n: " ".join(part() + part() for _ in range(rng.randint(1, n)))
    config = {name(2) + str(k): {"aliases": [name(2) for _ in range(3)], "model_name": {
        name(2): {"aliases": [name(3) for _ in range(3)]} for _ in range(5)}} for k in range(20)}
    brands = [a for b, d in config.items() for a in [b, *d["aliases"]]]
    models = [a for d in config.values() for m, x in d["model_name"].items() for a in [m, *x["aliases"]]]
    lines = {" ".join([rng.choice([rng.choice(brands), rng.choice(brands).upper(), name(1)]), rng.choice(["", "【a】"]), name(1) * rng.randint(0, 1),
                       rng.choice(models), rng.choice(["", "116500LN", "AB-1 x"]), rng.choice(["", "メンズ", "時計 z"])]) for _ in range(400)}
    frame = spark.createDataFrame([(t,) for t in lines] * 2, "title string")
    got = titles.split_titles(frame, AliasDictionary.from_config(spark, config)).collect()
    assert len(got) == 2 * len(lines)
    for r in got:
        assert (r.brand_name, r.model_name, r.model_no) == plain_split(r.title, config), r.title


def test_titles_are_cleaned_once_and_hits_gathered_by_rank(spark, any_dictionary):
    """Rows meet the answers by the title as written, so that cleaning is no part of their join, and no step sorts hits."""
    lines = ["ROLEX  デイトナ 116500", "【x】ROLEX デイトナ 116500", "ROLEX  デイトナ 116500", None, "メンズ"]
    frame = spark.createDataFrame(list(enumerate(lines)), "id int, title string")
    found = titles.split_titles(frame, any_dictionary)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "【" not in plan
    whole = ("ROLEX デイトナ 116500", "ROLEX", "デイトナ", "116500")
    assert {r.id: (r.clean_title, r.brand_name, r.model_name, r.model_no) for r in found.collect()} == {
        0: whole, 1: whole, 2: whole, 3: (None,) * 4, 4: ("メンズ", None, None, None)}


def test_title_rule_of_a_profile(spark, any_dictionary):
    profile = rules.parse_profile({"name": "p", "parse": {"fields": {
        "heading": {"pattern": "<p>.*?</p>", "text": True, "transforms": [{"type": "strip"}, {"type": titles.RULE}]}}}})
    other = rules.parse_profile({"name": "q", "parse": {"fields": {"heading": {"pattern": "<p>.*?</p>"}}}})
    items = spark.createDataFrame([(1, "p", {"heading": "【x】ROLEX  デイトナ 116500", "model_no": "old", "price": "5"}),
                                   (2, "p", {"price": "5"}), (3, "q", {"heading": "ROLEX"}), (4, "p", {"heading": "メンズ"}),
                                   (5, None, None)], "id long, profile string, item map<string,string>")
    got = {r.id: r.item for r in titles.split_title_fields(items, [profile, other], any_dictionary).collect()}
    assert got[1] == {"heading": "ROLEX デイトナ 116500", "brand_name": "ROLEX", "model_name": "デイトナ", "model_no": "116500", "price": "5"}
    assert got[2] == {"price": "5"} and got[3] == {"heading": "ROLEX"} and got[4] == {"heading": "メンズ"} and got[5] is None


# ---- search -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def docs(items, dictionary):
    return saved(search.build_documents(items, dictionary))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, query string")


def test_document(docs):
    one = docs.where("id = 1").first()
    assert one.brand_aliases == ["Rolex", "ロレックス", "劳力士"]  # ROLEX repeats Rolex
    assert one.search_text == "Rolex ロレックス 劳力士 Daytona デイトナ Cosmograph Daytona 迪通拿 116 500ln"
    assert one.suggest_input[:3] == ["ロレックス", "デイトナ", "116 500ln"]
    assert docs.where("id = 6").first().suggest_input[-1] == "1815"


def test_single_characters_match_but_exact_narrowing_removes_them(spark, docs):
    hits = {(r.query_id, r.id) for r in search.match(asked(spark, "爱彼", "朗格"), docs, fuzzy=False).collect()}
    assert {(1, 3), (1, 4), (2, 5), (2, 8)} <= hits
    kept = {(r.query_id, r.id) for r in search.search(asked(spark, "爱彼", "朗格"), docs).collect()}
    assert kept == {(1, 3), (1, 9), (2, 5), (2, 6)}


def test_blank_and_star_queries_list_everything(spark, docs):
    got = search.search(asked(spark, "*", "  ", "Daytona"), docs, page_size=4).collect()
    pages = {q: [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2, 3)}
    assert pages[1] == pages[2] == [9, 8, 7, 6]
    assert {r.total for r in got if r.query_id == 2} == {9}
    assert sorted(pages[3]) == [1, 2]


def test_sort_filter_page_and_recall(spark, docs):
    star = asked(spark, "*")
    by_price = search.search(star, docs, sort_field="price", order="asc", page_size=9).orderBy("rank")
    assert [r.id for r in by_price.collect()] == [7, 9, 8, 4, 6, 5, 2, 1, 3]  # missing price last
    cheap = search.search(star, docs, filters={"max_price": 50, "category": "watch"}, page_size=2, page=2)
    assert [r.id for r in cheap.collect()] == [4]
    assert {r.total for r in search.search(star, docs, page_size=1, recall=5).collect()} == {5}
    assert {r.total for r in search.search(star, docs, page_size=1).collect()} == {9}


def osa(a, b):
    """Edit distance with neighbour exchanges, the plain table."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_fuzzy_terms_are_complete(spark):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 10))) for _ in range(160)})
    terms, vocab = words[::2], words[1::2]
    got = {(r.term, r.match): r.edits for r in search.fuzzy_terms(
        spark.createDataFrame([("f", t) for t in terms], "field string, term string"),
        spark.createDataFrame([("f", t) for t in vocab], "field string, term string")).collect()}
    room = {t: 0 if len(t) <= 2 else 1 if len(t) <= 5 else 2 for t in terms}
    assert got == {(t, v): osa(t, v) for t in terms for v in vocab if osa(t, v) <= room[t]}


def test_few_fuzzy_queries_go_to_the_vocabulary(spark):
    """The pieces of query terms are stored, so that few of them are broadcast and those of the vocabulary stay in place."""
    terms = spark.createDataFrame([("f", "daytona")], "field string, term string")
    vocab = spark.range(1000).select(F.lit("f").alias("field"), F.concat(F.lit("dayton"), "id").alias("term")).rdd.toDF()
    close = search.fuzzy_terms(terms, vocab)
    assert close.count() == 100  # one digit for the last letter, or two
    plan = close._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_plain_letters_are_part_of_longer_tokens(spark):
    row = spark.createDataFrame([("ABCé9я 漢aカナーbひ1-é2 ÉA",)], "t string").select(text.tokens("t").alias("t")).first()
    assert row.t == ["abcé9я", "漢", "a", "カナー", "b", "ひ", "1", "é2", "éa"]


def test_suggestions(docs):
    def terms(prefix, size=5):
        return [r.term for r in search.suggest(docs, prefix, size).orderBy("place").collect()]
    assert terms("rol") == ["rolex ", "Rolex"] or terms("rol")[0].strip().lower() == "rolex"
    assert terms("劳") == ["劳力士"]
    assert terms(" ") == []
    assert len(terms("r", 2)) == 2


def test_suggestions_from_an_index(spark, docs):
    """Every beginning of every term in three spellings, whole index and merged parts, as document scans answer them."""
    terms = {t for r in docs.collect() for t in [r.brand_name, r.model_name, r.model_no, *r.brand_aliases, *r.model_aliases] if t}
    asked = sorted({f(t[:n]) for t in terms for n in (1, 2, 5, len(t)) for f in (str, str.upper, str.lower)} | {"", "  ", " ro ", "zz", "#"})
    table = spark.createDataFrame([(a,) for a in asked] + [("ro",)] * 3, "prefix string")
    whole = saved(prefixes.prefix_index(docs, 3))
    parts = saved(prefixes.merge_indexes([prefixes.prefix_index(docs.where(F.col("id") % 3 == k), 3) for k in range(3)], 3))
    answers = [{}, {}]
    for found, index in zip(answers, (whole, parts)):
        for r in prefixes.suggest_batch(index, table, 3).orderBy("prefix", "place").collect():
            found.setdefault(r.prefix, []).append(r.term)
    assert answers[0] == answers[1]
    for a in asked[::7]:
        assert answers[0].get(a, []) == [r.term for r in search.suggest(docs, a, 3).collect()], a
    assert prefixes.suggest_batch(whole, table.limit(0)).count() == prefixes.prefix_index(docs.limit(0)).count() == 0


def test_documents_of_like_names_share_their_entries(spark, docs):
    """Documents that differ in number alone give the entries of their names once, and the points of each number still count."""
    many = docs.limit(3).select("*", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k")).withColumns({
        "id": F.col("id") + 1000 * F.col("k"), "model_no": F.concat(F.when(F.col("k") % 2 == 0, "R").otherwise("9"), F.col("k").cast("string"))})
    many = saved(many.withColumn("search_text", F.concat_ws(" ", F.array_join("brand_aliases", " "), "model_no")).drop("k"))
    names = prefixes.prefix_entries(many).where("pos <> 2")
    once = names.groupBy("cased", "prefix", "term", "pos", "score").count()
    assert names.count() < 3 * once.count()
    table = spark.createDataFrame([(p,) for p in ("r", "R", "ro", "RO", "9", "R1", "r1", "91")], "prefix string")
    got = {}
    for r in prefixes.suggest_batch(saved(prefixes.prefix_index(many, 3)), table, 3).orderBy("prefix", "place").collect():
        got.setdefault(r.prefix, []).append(r.term)
    for r in table.collect():
        assert got.get(r.prefix, []) == [x.term for x in search.suggest(many, r.prefix, 3).collect()], r.prefix


def test_index_upkeep(spark, items, docs, dictionary):
    ids = search.affected_items(items, spark.createDataFrame([("Rolex",)], "brand_name string"))
    assert [r.id for r in ids.collect()] == [8]  # stored spelling only
    ids = search.affected_items(items, spark.createDataFrame([("Rolex",)], "brand_name string"), dictionary=dictionary)
    assert sorted(r.id for r in ids.collect()) == [1, 2, 8]
    assert search.refresh_documents(docs.where("id <> 1"), items, ids, dictionary).count() == 9
    assert search.delete_documents(docs, spark.createDataFrame([(1,), (99,)], "id long")).count() == 8
    assert search.changed_items(items, dt.datetime(2024, 1, 8)).count() == 2
    assert search.changed_items(items).count() == 9
    assert [r.id for r in search.inspect_model(docs, "daytona").collect()] == [2]
