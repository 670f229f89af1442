"""Named queries of the operators, each over a whole table, and SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tanadex.llm import (language, lexicon, lines, mixing, negatives, packing, phrases, private, quality, retrieval,
                         simhash, substrings, tokens)
from tanadex.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    cut = lines.without_boilerplate(pages, lines.host_of(F.col("url")), lines.html_lines(F.col("html")))
    return cut.select(F.col("row.page_id").alias("page_id"), "host", "n_lines", "n_dropped", "text")


CHECKS["op1_line_dedup"] = f"""
    WITH base AS (
      SELECT page_id, row_number() OVER () AS r,
        lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
        html IS NULL AS gone, string_split(coalesce(regexp_replace(regexp_replace(regexp_replace(
          html, '{lines.UNSEEN}', chr(10), 'g'), '{lines.BREAKS}', chr(10), 'g'), '{lines.TAGS}', '', 'g'), ''), chr(10)) AS ls
      FROM pages),
    each AS (
      SELECT r, page_id, host, gone, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM base),
    bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM each),
    often AS (
      SELECT host, t, count(DISTINCT r) AS n FROM bare WHERE t <> '' GROUP BY host, t),
    totals AS (SELECT host, count(*) AS total FROM base GROUP BY host),
    drops AS (
      SELECT host, t, 1 AS dropped FROM often JOIN totals USING (host)
      WHERE n >= {lines.MIN_PAGES} AND n > {lines.MAX_RATIO} * total)
    SELECT page_id, host, count(*) FILTER (t <> '') AS n_lines, count(dropped) AS n_dropped,
      CASE WHEN NOT any_value(gone)
           THEN coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (dropped IS NULL), '') END AS text
    FROM bare LEFT JOIN drops USING (host, t) GROUP BY r, page_id, host"""


@query
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.predictions(table(spark, folder, "documents"))


@query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "documents"))


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return judged.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "score", "base_failed", "kept")


@query
def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return private.personal_data(table(spark, folder, "documents"))


@query
def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).drop("source")


@query
def op9_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.top_products(table(spark, folder, "embeddings"), F.col("vec_id") % retrieval.EVERY == 0)


CHECKS["op9_exact_top_k"] = f"""
    WITH v AS (
      SELECT row_number() OVER () AS r, vec_id, CAST(list_transform(embedding, lambda x: CAST(
          floor({retrieval.SCALE}.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS BIGINT[]) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
      SELECT q.r, q.vec_id AS query_id, c.vec_id,
        CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % {retrieval.EVERY} = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM pairs) x
    WHERE rank <= {retrieval.TOP}"""


@query
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeated_words(table(spark, folder, "documents"))


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % negatives.EVERY == 0, shifted)


CHECKS["op11_hard_negatives"] = f"""
    WITH v AS (
      SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        CAST(list_transform(embedding, lambda x: CAST(floor({negatives.SCALE}.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS BIGINT[]) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
      SELECT a.r AS ar, a.vec_id AS anchor_id, c.r AS cr, c.vec_id, a.label = c.label AS same,
        CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda x: x[1] * x[2])), 0) AS BIGINT) AS score
      FROM v a JOIN v c ON a.r <> c.r AND len(a.v) = len(c.v) WHERE a.vec_id % {negatives.EVERY} = 0),
    positives AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, cr) AS k FROM pairs WHERE same) x
      WHERE k <= {negatives.POSITIVES}),
    windows AS (
      SELECT p.ar, p.cr, p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score,
        n.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.cr ORDER BY n.score DESC, n.vec_id) AS rank
      FROM positives p JOIN pairs n ON p.ar = n.ar AND NOT n.same
        AND {negatives.LOW} * p.score <= {negatives.HIGH} * n.score AND n.score <= p.score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
    FROM windows WHERE rank <= {negatives.NEGATIVES}"""


@query
def op12_lexicon_bpe(spark: SparkSession, folder: str) -> DataFrame:
    both = lexicon.decoded(lexicon.encoded(table(spark, folder, "documents")))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


@query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


CHECKS["op13_collocations"] = f"""
    WITH pieces AS (
      SELECT coalesce(lang, '{phrases.NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    runs AS (
      SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
    starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM runs),
    grams AS (
      SELECT lang, CAST(k AS BIGINT) AS k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM starts, (SELECT unnest(range(1, {phrases.LONGEST} + 1)) AS k) WHERE i + k - 1 <= len(w)),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM runs GROUP BY lang),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
    c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
    scored AS (
      SELECT cuts.lang, cuts.phrase, cuts.a, cut, x.a AS l, y.a AS r,
        CAST({phrases.SCALE}::HUGEINT * cuts.a // (x.a + y.a) AS BIGINT) AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cut], ' ')
        JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
    weakest AS (
      SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    sizes AS (SELECT *, unnest(range(2, k)) AS size FROM c WHERE k > 2),
    inner_runs AS (SELECT *, unnest(range(1, k - size + 2)) AS i FROM sizes),
    covers AS (
      SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS longer FROM inner_runs GROUP BY ALL),
    kept AS (
      SELECT weakest.* FROM weakest LEFT JOIN covers USING (lang, phrase)
      WHERE longer IS NULL OR 100::HUGEINT * longer < {phrases.COVER}::HUGEINT * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
      phrase, a, l, r, n, score FROM kept JOIN totals USING (lang)
    QUALIFY rank <= {phrases.REPORT}"""


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)
