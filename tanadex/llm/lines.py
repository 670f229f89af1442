"""Line dedup by site-relative frequency, in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tanadex.llm.common import SPACE_CHARS, words_of, wrapped

# A line is boilerplate on a host if more than this share of the host's pages hold it, and no fewer than so many pages.
MAX_RATIO = 0.1
MIN_PAGES = 3
# Pieces that the pages of each host are dealt into.
SALTS = 16

# Markup without text, tags that end a line, all other tags.
UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BREAKS = (r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|article|section|nav|header|footer|main|aside|table|tr|td|th|"
          r"title|head|body|html|form|option|blockquote|pre|figure|figcaption)\b[^>]*>")
TAGS = r"<[^>]*>"


def html_lines(html: Column) -> Column:
    """The text of a page with one line per block; markup is dropped, entities stay as written."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, UNSEEN, "\n"), BREAKS, "\n"), TAGS, "")


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user or port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE_CHARS))


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, min_words: int = 1) -> DataFrame:
    """(host, drops): hashes of the boilerplate lines of each host, from (host, lines).

    Lines of fewer than ``min_words`` words are never boilerplate; at 1 all lines can be. A page counts once for each line it holds; counts are summed before they are shuffled. A host has at most
    (distinct lines per page) / ratio such lines, so the array does not grow with the host.
    """
    long = (lambda x: x != "") if min_words <= 1 else (lambda x: F.size(words_of(x)) >= min_words)
    held = F.array_distinct(F.filter(F.transform("lines", _bare), long))
    counts = (pages.select("host", F.explode(held).alias("line")).groupBy("host", F.xxhash64("line").alias("h"))
              .agg(F.count(F.lit(1)).alias("n")))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    frequent = (counts.where(F.col("n") >= min_pages).join(totals, "host")
                .where(F.col("n") > F.lit(max_ratio) * F.col("total")))
    return frequent.groupBy("host").agg(F.collect_list("h").alias("drops"))


def without_boilerplate(docs: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO,
                        min_pages: int = MIN_PAGES, min_words: int = 1) -> DataFrame:
    """``row`` with host, n_lines, n_dropped and the text of the lines that stay, for every row of ``docs``.

    Lines end at \\n and are compared without outer white space; blank lines are no lines to count and always stay.
    A null text stays null with no lines; a null host counts as the empty host. Repeated rows count as pages of their
    own. A line on exactly ``max_ratio`` of the pages stays, and so does a line of fewer than ``min_words`` words. Very long texts stay inside their row.
    Pages meet their host's lines dealt out over ``SALTS`` pieces, so a host with a third of all pages is no hot group.
    """
    base = docs.select(F.coalesce(host, F.lit("")).alias("host"), F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"))
    drops = boilerplate(base, max_ratio, min_pages, min_words)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    dealt = drops.select("host", "drops", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = (wrapped(docs, host=F.coalesce(host, F.lit("")), text=text).withColumn("salt", salt)
           .join(dealt, ["host", "salt"], "left")
           .withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n")))
    stays = F.filter("lines", lambda x: (_bare(x) == "") | ~F.array_contains("drops", F.xxhash64(_bare(x))))
    cut = met.withColumn("stays", F.when(F.col("drops").isNull(), F.col("lines")).otherwise(stays))
    real = F.size(F.filter("lines", lambda x: _bare(x) != ""))
    return cut.select("row", "host", real.cast("long").alias("n_lines"),
                      (F.size("lines") - F.size("stays")).cast("long").alias("n_dropped"),
                      F.when(F.col("text").isNotNull(), F.array_join("stays", "\n")).alias("text"))
