"""Extraction rules, stored files and streams."""

import os

from pyspark.sql import functions as F

from tanadex.functions.strategies import STRATEGIES, decode_entities, text_content
from tanadex.operators import changes, extract, images
from tanadex.sources import files, rules
from tanadex.streaming import sync
from tests.test_changes import SCHEMA, TINY, fold, random_rows

CARDS = """
id: cards
site: shop.example
category: watch
match: {url_regex: "^https://shop\\\\.example/list(\\\\?.*)?$", priority: 20}
fetch: {engine: browser}
pagination: {next_page: {selector: a}}
parse:
  type: list
  item_selector_pick: first_non_empty
  item_patterns: ["<article.*?</article>", "<li\\\\b.*?</li>"]
  fields:
    product_url:
      pattern: "<a\\\\s[^>]*href=[^>]*/products/[^>]*>"
      attr: href
      transforms: [{type: url_join, base: "https://shop.example"}, {type: strip}]
    image:
      patterns: ["<figure.*?</figure>", "<img[^>]*>"]
      attr_candidates: [src, data-src, srcset]
      transforms: [{type: pick_best_srcset}, {type: replace, from: "//", to: "https://"}]
    model_no:
      pattern: ":root"
      text: true
      transforms: [{type: regex_capture, pattern: "Ref\\\\.?\\\\s*([0-9A-Z,]+)", group: 1}, {type: replace, from: ",", to: ""}]
    price_jpy:
      pattern: ":root"
      text: true
      transforms: [{type: regex_capture, pattern: "¥([0-9,]+)"}, {type: replace, from: ",", to: ""}, {type: to_int}]
  post_list_process: [{method: deduplicate_by_url, config: {url_field: product_url}}, {method: unknown}]
"""
LIST_PAGE = """<ul><li><a class=x href="/products/a1">A</a><img src="" data-src="//i.example/1.png">Ref. 116,500LN
 &yen;1,200</li><li><a class=x href="/products/b2?x&amp;y">B</a><img srcset="s.jpg 1x, t.jpg 2x">Ref 12 &#165;900</li>
<li>no link ¥5</li><li><a class=x href="/products/a1">again</a></li></ul>"""
DETAIL = """<script type="application/ld+json">{broken</script><script type='application/ld+json'>
 [{"x": 1}, {"name": "N", "offers": {"price": 12}}]</script><title> T </title><h1>H</h1>"""
OLD = {"name": "detail", "match": {"domains": ["d.example:8080"], "priority": 5}, "fields": {
    "name": [{"type": "jsonld", "config": {"path": "name"}}],
    "price": [{"type": "jsonld", "config": {"path": "offers.price"}}],
    "title": [{"type": "regex", "config": {"pattern": "<h9>(.*)</h9>"}}, {"type": "tag", "config": {"pattern": "<title>.*?</title>"}}],
    "none": [{"type": "regex", "config": {"pattern": "zzz"}}]}}
PAGES = [(1, "https://shop.example/list?p=2", LIST_PAGE, 200), (2, "http://d.example:8080/x", DETAIL, 200),
         (3, "http://d.example/x", DETAIL, 200), (4, "https://shop.example/list", "<p>nothing</p>", 404)]


def load(tmp_path):
    (tmp_path / "a.yaml").write_text(CARDS, encoding="utf-8")
    (tmp_path / "b.yaml").write_text("{broken: [", encoding="utf-8")
    import yaml
    (tmp_path / "c.yml").write_text(yaml.safe_dump({"profiles": [OLD, {"name": "never", "match": {"priority": 99}}]}))
    return rules.load_profiles(str(tmp_path))


def test_rules_and_records(spark, tmp_path):
    profiles = load(tmp_path)
    assert [p.name for p in profiles] == ["never", "cards", "detail"]
    pages = spark.createDataFrame(PAGES, files.PAGE_SCHEMA)
    records = {r.page_id: r for r in extract.extract_records(pages, profiles).collect()}
    assert set(records) == {1, 2, 4}  # a port is part of the host; no fallback profile
    assert records[1]["items"] == [
        {"product_url": "https://shop.example/products/a1", "image": "https://i.example/1.png", "model_no": "116500LN",
         "price_jpy": "1200", "category": "watch"},
        {"product_url": "https://shop.example/products/b2?x&y", "image": "t.jpg", "model_no": "12",
         "price_jpy": "900", "category": "watch"}]
    assert records[2]["items"] == [{"name": "N", "price": "12", "title": "T"}]
    assert [(e.field, e.error) for e in records[2].errors] == [("none", extract.NO_VALUE)]
    assert records[4]["items"] == [] and [e.field for e in records[4].errors] == ["items"]
    log = extract.log_rows(extract.explode_items(extract.extract_records(pages, profiles)),
                           F.lit("2024-01-01 00:00:00").cast("timestamp"), last_log_id=10).orderBy("log_id").collect()
    assert [(r.log_id, r.price, r.model_no, r.source_uid) for r in log] == [
        (11, 1200, "116500LN", "shop.example:"), (12, 900, "12", "shop.example:"), (13, 12, None, "d.example:")]


def test_text_and_entities(spark):
    frame = spark.createDataFrame([("<p>a<br>&lt;b&gt; &#x4e2d;&#65;&#zz &amp;lt;</p><script>x</script><!-- y -->",)], "h string")
    assert frame.select(text_content(F.col("h"))).first()[0] == "a<b> 中A&#zz &lt;"
    assert frame.select(decode_entities(F.lit("plain"))).first()[0] == "plain"
    whole = STRATEGIES["jsonld"](F.lit(DETAIL), {"path": "missing.path"})
    assert frame.select(whole).first()[0].startswith('[{"x": 1}')


def test_url_lists(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# c\n https://a \n\nhttps://b\n", encoding="utf-8")
    assert [r.url for r in files.read_url_list(spark, str(tmp_path / "u.txt")).collect()] == ["https://a", "https://b"]
    assert files.urls_of({"urls": {"g": ["a", 1], "h": "x"}}) == ["a"]
    assert files.urls_of({"g": ["a"], "h": ["b"], "n": 3}) == ["a", "b"] and files.urls_of(["a", None]) == ["a"]
    (tmp_path / "u.yaml").write_text("urls: [a, b, 3]", encoding="utf-8")
    assert files.read_url_list(spark, str(tmp_path / "u.yaml")).count() == 2


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("s.example", "i/1", "B", None, bytearray(b"x")), ("t", "", "C", "m", None)],
                                 "site string, item_id string, brand_name string, model_no string, raw binary")
    files.write_jsonl(rows, str(tmp_path / "j"))
    assert "raw" not in spark.read.json(str(tmp_path / "j")).columns
    files.write_key_value_text(rows.drop("raw"), str(tmp_path / "kv"))
    text = spark.read.text(str(tmp_path / "kv")).first()
    assert text.site == "s" and '"name":"i_1"' in text.value and "brand_name: B" in text.value
    os.makedirs(tmp_path / "t" / "shop")
    (tmp_path / "t" / "shop" / "1.txt").write_text("item_id: 1\nbrand_name: ロレックス: x\nprice_jpy: 12\n", encoding="utf-8")
    one = files.read_key_value_text(spark, str(tmp_path / "t")).first()
    assert (one.site, one.brand_name, one.price_jpy, one.model_no) == ("shop", "ロレックス: x", "12", None)
    (tmp_path / "t" / "shop" / "a.png").write_bytes(b"img")
    keys = images.new_images(images.image_keys(files.read_images(spark, str(tmp_path / "t"), "*.png"))).first()
    assert keys.image_original_key == f"original/{keys.image_sha256[:2]}/{keys.image_sha256}.png"
    assert [r.key for r in files.list_objects(spark, str(tmp_path / "t"), "shop/a").collect()] == ["shop/a.png"]


def test_stored_texts_are_read_back(spark, tmp_path):
    """Values with line ends come back whole, also the last one, and nulls stay null."""
    rows = [("s.example", "1", "a: b\nplain\n\nc:d", None, "x"), ("t", "2", "one", "two", "last\nline\n"), ("t", "3", None, "", "y: z")]
    items = spark.createDataFrame(rows, "site string, item_id string, brand_name string, model_no string, category string")
    files.write_key_value_text(items, str(tmp_path / "kv"))
    keys = ("item_id", "brand_name", "model_no", "category")
    got = files.read_key_value_items(spark, str(tmp_path / "kv"), keys).select(*keys).collect()
    assert sorted(map(tuple, got)) == [r[1:] for r in rows]


def test_stored_texts_are_split_once(spark):
    """The text of a row is split once, not once for each comparison of its entries; entries without a value stay out."""
    text = spark.createDataFrame([("a: 1\r\nb:\nx: y\nc:\n1\n2\na: 3\nb:\nc: z",), ("no\na: 1",), ("",), (None,)], "t string")
    found = text.select(files.parse_key_value_text(F.col("t"), ("a", "b", "c")).alias("m"))
    assert [r.m for r in found.collect()] == [{"a": "3", "c": "z"} | {"b": "x: y"}, {"a": "1"}, {}, None]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_extract") == 0


def test_src_kv_text_writes_files(spark, tmp_path, monkeypatch):
    from tanadex.plans import catalogue
    from tanadex.plans.registry import QUERIES
    monkeypatch.setattr(catalogue, "shared_path", lambda _: str(tmp_path / "kv"))
    rows = QUERIES["src_kv_text"](spark, "/root/testdata/sf0.001")
    assert list((tmp_path / "kv").rglob("part-*")) and rows.inputFiles()
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_objects_of_sites_are_written_side_by_side(spark, tmp_path, monkeypatch):
    """One object a site, each written by a task of its own, with a line for each item."""
    from tanadex.plans import catalogue
    from tanadex.plans.registry import QUERIES
    monkeypatch.setattr(catalogue, "shared_path", lambda _: str(tmp_path / "o"))
    sizes = {r.site: (r.n_objects, r.n_bytes) for r in QUERIES["object_listing"](spark, "/root/testdata/sf0.001").collect()}
    files_ = list((tmp_path / "o").rglob("part-*"))
    assert len(files_) == sum(n for n, _ in sizes.values()) == len({f.name[:10] for f in files_}) > 5
    assert sorted(f.stat().st_size for f in files_) == sorted(b for n, b in sizes.values() if n)


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    rows = random_rows(21, 90)
    log = spark.createDataFrame(rows, SCHEMA)
    full = log.select(*[F.col(f.name) if f.name in log.columns else F.lit(None).cast(f.dataType).alias(f.name)
                        for f in sync.LOG_SCHEMA])
    source, store = str(tmp_path / "log"), sync.ItemStore(spark, str(tmp_path / "store"))
    assert store.missing_tables() == ["items", "history", "state"]

    def feed(low, high):
        full.where((F.col("log_id") > low) & (F.col("log_id") <= high)).coalesce(1).write.mode("append").parquet(source)

    def run():
        sync.sync_items(sync.stream_log(spark, source, max_files=1), store, str(tmp_path / "cp"), skew=TINY
                        ).awaitTermination()

    feed(0, 30)
    run()
    feed(30, 60)
    feed(60, 90)
    run()
    expected, items = fold(rows)
    got = sorted(((r.source_uid, r.log_id) for r in store.history().collect()), key=str)
    assert got == sorted(((c[0], c[1]) for c in expected), key=str)
    assert {r.source_uid: (r.price, r.version) for r in store.items().collect()} == {
        u: (i["price"], i["version"]) for u, i in items.items()}
    assert store.cursor(store.version()) == max(r[0] for r in rows if r[14] == "success")

    again = sync.ItemStore(spark, str(tmp_path / "once"))
    sync.sync_once(log, again, max_records=25)
    sync.sync_once(log, again)
    assert again.history().count() == len(expected)
    assert again.items().count() == len(items)


def test_store_rewrites_only_touched_buckets(spark, tmp_path):
    """Files are counted: a batch of one item writes one bucket, a repeated batch changes no row, old buckets go."""
    log = spark.createDataFrame(random_rows(5, 120), SCHEMA)
    log = log.select(*[F.col(f.name) if f.name in log.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in sync.LOG_SCHEMA])
    store = sync.ItemStore(spark, str(tmp_path / "s"), buckets=8)
    folder = lambda v: {d for d in os.listdir(tmp_path / "s" / "items" / f"v={v}") if d.startswith("bucket=")}
    rows = lambda df: sorted(map(str, df.collect()))
    store.apply(log.where("log_id <= 60"), 0, TINY)
    first = store.items().orderBy("source_uid").first()
    one = log.where((F.col("log_id") > 60) & (F.concat_ws(":", F.trim("site"), F.trim("category"), F.trim("item_id")) == first.source_uid))
    assert one.count() and len(folder(0)) > 1
    store.apply(one, 1, TINY)
    assert len(folder(1)) == 1 and not store.missing_tables()
    before = rows(store.items()), rows(store.history())
    store.apply(one, 1, TINY)
    assert (rows(store.items()), rows(store.history())) == before and len(folder(1)) == 1
    other = log.where(F.col("log_id") > 60).join(one.select("log_id"), "log_id", "left_anti")
    store.apply(other.where("log_id <= 90"), 2, TINY)
    store.apply(other.where("log_id > 90"), 3, TINY)
    store.apply(log.limit(0), 4, TINY)
    kept = set(os.listdir(tmp_path / "s" / "state")) - {"_SUCCESS"}
    assert {k for k in kept if k.startswith("v=")} == {"v=3", "v=4"}
    used = {v.split(":")[0] for v in store._buckets(store._state(3)).values()} | set(store._buckets(store._state(4)).values())
    on_disk = {str(tmp_path / "s" / "items" / v / b) for v in os.listdir(tmp_path / "s" / "items") for b in
               os.listdir(tmp_path / "s" / "items" / v) if b.startswith("bucket=")}
    assert on_disk == used
    ids = [r.id for r in store.items().select("id").collect()]
    assert len(set(ids)) == len(ids) == changes.current_items(changes.valid_log(changes.pending_log(log, -1))).count()
    assert store.stats().agg(F.sum("total"), F.sum("failed")).first() == (
        changes.pending_log(log, -1).count(), store.rejects().count())


def test_page_stream(spark, tmp_path):
    os.makedirs(tmp_path / "rules")
    profiles = load(tmp_path / "rules")
    for k, page in enumerate(PAGES):
        spark.createDataFrame([page], files.PAGE_SCHEMA).write.mode("append").parquet(str(tmp_path / "pages"))
    sync.extract_to_log(files.stream_pages(spark, str(tmp_path / "pages"), 2), profiles, str(tmp_path / "out"),
                        str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.log_id for r in out.collect()) == [1, 2, 3]
    assert changes.pending_count(out).first()[0] == 3
