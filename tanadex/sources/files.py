"""URL lists, record files, key/value text files, images and relational tables."""

from __future__ import annotations

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tanadex.functions import scalars
from tanadex.functions.text import let, strip
from tanadex.model import PAGE_SCHEMA

# Keys of the stored item text files.
TEXT_KEYS = ("product_url", "item_id", "brand_name", "model_name", "model_no",
             "brand_name_model_name_model_no", "price_jpy", "category")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages, one row each; a table without status codes gets 200."""
    pages = spark.read.parquet(path)
    if "status_code" not in pages.columns:
        pages = pages.withColumn("status_code", F.lit(200))
    return pages.select(*[F.col(f.name).cast(f.dataType) for f in PAGE_SCHEMA])


def stream_pages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a text file (``#`` starts a comment) or of a YAML file."""
    if path.lower().endswith((".yaml", ".yml")):
        text = "\n".join(r.value for r in spark.read.text(path).toLocalIterator())
        rows = [(u,) for u in urls_of(yaml.safe_load(text))]
        return spark.createDataFrame(rows, "url string")
    line = strip("value")
    return (spark.read.text(path).select(line.alias("url"))
            .where((F.col("url") != "") & ~F.col("url").startswith("#")))


def urls_of(config) -> list[str]:
    """Strings of a URL configuration: a list, a ``urls`` list or groups, or all lists."""
    if isinstance(config, dict) and "urls" in config:
        config = config["urls"]
    groups = config.values() if isinstance(config, dict) else [config]
    return [u for group in groups if isinstance(group, list) for u in group if isinstance(u, str)]


def write_jsonl(records: DataFrame, path: str) -> None:
    """Append ``{url, data, errors}`` lines; binary columns are left out."""
    kept = [f.name for f in records.schema if not isinstance(f.dataType, T.BinaryType)]
    records.select(*kept).write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(record, line) of stored records whose fields no schema fixes; ``record`` is null for a line that is no JSON."""
    lines = spark.read.text(path).where(strip("value") != "")
    return lines.select(F.try_parse_json("value").alias("record"), F.col("value").alias("line"))


def typed_fields(record: Column, rules: dict[str, tuple[str, str]]) -> list[Column]:
    """A column for each rule ``name: (path, type)``; null where the field is missing or of another type."""
    return [F.try_variant_get(record, path, kind).alias(name) for name, (path, kind) in rules.items()]


def key_value_text(columns) -> Column:
    """``key: value`` lines of the non-null columns; a multi-line value starts a new line."""
    lines = []
    for name in columns:
        if name.startswith("_") or name == "image":
            continue
        value = F.col(name).cast("string")
        lines.append(F.when(value.contains("\n"), F.concat(F.lit(f"{name}:\n"), value))
                     .otherwise(F.concat(F.lit(f"{name}: "), value)))
    return F.concat_ws("\n", *lines)


def write_key_value_text(items: DataFrame, path: str) -> None:
    """Item texts below one directory per site, many items to a file."""
    text = key_value_text([c for c in items.columns if c != "site"])
    (items.where(~scalars.strip(F.coalesce("item_id", F.lit(""))).eqNullSafe(""))
     .select(scalars.site_dir("site").alias("site"),
             F.to_json(F.struct(scalars.safe_name("item_id").alias("name"),
                                text.alias("text"))).alias("value"))
     .write.mode("append").partitionBy("site").text(path))


def parse_key_value_text(text: Column, keys=None) -> Column:
    """Map of the ``key: value`` lines of one text; the last line of a key counts.

    ``key:`` alone on a line starts a value of several lines, up to the next key or the end. ``keys`` names the keys
    that there are; without it any word is one. A line of a value that looks like a key is read as one.
    """
    key = "|".join(keys) if keys else r"\w+"
    starts = rf"(?:{key}):(?: |\r?\n)"

    def pair(entry):  # a key holds no colon, and every entry but the first is known to begin with one
        name = F.substring_index(entry, ":", 1)
        rest = F.substring(entry, F.length(name) + 2, F.length(entry))
        line = F.substring_index(F.substring_index(F.substring(rest, F.lit(2), F.length(rest)), "\n", 1), "\r", 1)
        below = F.substring(rest, F.when(rest.startswith("\r"), 3).otherwise(2), F.length(rest))
        return F.struct(name.alias("key"), F.when(rest.startswith(" "), line).otherwise(below).alias("value"))

    def last(pairs):  # split once per row, then compared by key alone
        return let(F.transform(pairs, lambda p: p["key"]), lambda names: F.when(
            F.size(F.array_distinct(names)) == F.size(names), pairs).otherwise(F.filter(
                pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["key"]))))
    entries = F.filter(F.split(text, rf"\r?\n(?={starts})", -1), lambda x, i: F.when(
        i > 0, F.instr(x, ":") < F.length(x)).otherwise(x.rlike(rf"^{starts}")))
    return F.map_from_entries(let(F.transform(entries, pair), last))


def read_key_value_items(spark: SparkSession, path: str, keys=TEXT_KEYS) -> DataFrame:
    """One row per item that ``write_key_value_text`` stored: site, name and one string column per key."""
    stored = spark.read.schema("value string, site string").text(path)
    item = stored.select("site", F.from_json("value", "name string, text string").alias("item"))
    kv = item.select("site", "item.name", parse_key_value_text(F.col("item.text"), keys).alias("kv"))
    return kv.select("site", "name", *[F.try_element_at("kv", F.lit(k)).alias(k) for k in keys])


def read_key_value_text(spark: SparkSession, path: str, keys=TEXT_KEYS) -> DataFrame:
    """One row per text file, one string column per key, plus the file's directory as site."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    parsed = files.select(
        F.element_at(F.split(F.input_file_name(), "/"), -2).alias("site"),
        parse_key_value_text(F.col("value")).alias("kv"))
    return parsed.select("site", *[F.element_at("kv", k).alias(k) for k in keys])


def read_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def list_objects(spark: SparkSession, path: str, prefix: str = "",
                 glob: str | None = None) -> DataFrame:
    """Keys, sizes and times below a store; file contents are not read."""
    root = path.rstrip("/") + "/"
    key = F.substring_index("path", root, -1)
    return (read_images(spark, path, glob)
            .select(key.alias("key"), "length", "modificationTime")
            .where(F.col("key").startswith(prefix)))


def objects_of(wanted: DataFrame, objects: DataFrame, prefix: Column) -> DataFrame:
    """``wanted`` with the number and bytes of the objects that lie below each row's prefix, a whole folder or key.

    Keys meet prefixes by equality with each of their own beginnings that ends at a slash or at the end of the key.
    """
    parts = F.split("key", "/")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    below = objects.select("length", F.explode(begins).alias("_prefix")).groupBy("_prefix").agg(
        F.count(F.lit(1)).alias("n_objects"), F.sum("length").alias("n_bytes"))
    return (wanted.withColumn("_prefix", F.regexp_replace(prefix, "/+$", "")).join(below, "_prefix", "left").drop("_prefix")
            .withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_objects", "n_bytes")}))


def read_table(spark: SparkSession, url: str, table: str, lower: int, upper: int,
               partitions: int, key: str = "id", **options) -> DataFrame:
    """Relational table read in parallel by ranges of a numeric key."""
    return (spark.read.format("jdbc").options(url=url, dbtable=table, **options)
            .option("partitionColumn", key).option("lowerBound", lower)
            .option("upperBound", upper).option("numPartitions", partitions).load())


def write_table(rows: DataFrame, url: str, table: str, **options) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
