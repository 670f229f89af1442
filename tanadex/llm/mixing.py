"""Mixing sources to target weights: blocks of words, multinomial draws per output shard, permuted block indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanadex.llm.common import saved, words_of, wrapped

# Words of a block; the last block of a source may be shorter.
BLOCK = 128
# Weights of the sources in code point order, repeating; share of all words; most copies of a word.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
# Rounds of the permutation and its key.
ROUNDS = 16
SEED = 20
# Slots of an output shard in the mean, and documents of one piece of the layout.
SHARD_SLOTS = 4096
PIECE_DOCS = 10_000


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weighted shares, none above ``MOST`` times its size.

    Water filling in closed form: with sources in the order of the level at which they are full, a source is full if
    the level that empties the remaining share over the remaining weights is higher than its own.
    The table has one row a source; sources of no words get target 0.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]),
                          (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = (sizes.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
              .withColumn("weight", weight).withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
              .withColumn("full_at", F.col("cap") / F.col("weight")))
    order = W.orderBy("full_at", "place")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.lit(SHARE) * F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding,
                                                                                    W.unboundedFollowing))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = ranked.withColumn("level", level).withColumn(
        "level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(W.orderBy(F.lit(1)).rowsBetween(
            W.unboundedPreceding, W.unboundedFollowing)))
    return filled.select("source", "place", "source_size",
                         F.least("cap", F.coalesce("level", F.lit(float("inf"))) * F.col("weight")).alias("target"))


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. size - 1 for every key: ``ROUNDS`` rounds of swap-or-not.

    A round pairs x with (k - x) mod size and swaps the two or not, by a hash of the larger; both steps are
    one-to-one on any size.
    """
    size = F.greatest(size, F.lit(1))

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), size) - x, size)
        swap = F.pmod(F.xxhash64(*key, r, F.greatest(x, other)), F.lit(2)) == 1
        return F.when(swap, other).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, step)


def _laid_out(sized: DataFrame) -> DataFrame:
    """Place of each document among the words of its source: ``start`` words come before it.

    Documents of a source are dealt into pieces by a hash of their id. Only the sums of the pieces pass through a
    window of the whole source; documents are summed inside their piece.
    """
    pieces = F.lit(max(1, sized.count() // PIECE_DOCS))
    dealt = sized.withColumn("piece", F.pmod(F.xxhash64("doc_id", "size"), pieces))
    sums = dealt.groupBy("skey", "piece").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("skey").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("skey", "piece", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    inside = W.partitionBy("skey", "piece").orderBy("doc_id", "size", "rid").rowsBetween(W.unboundedPreceding, -1)
    return (dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(sums, ["skey", "piece"]).select("rid", "skey", "size", (F.col("base") + F.col("inside")).alias("start")))


def slots(sources: DataFrame) -> DataFrame:
    """The mix as slots (shard, skey, block, words): ``words`` words from the front of a block of a source.

    A source of S words and target T, rounded, gives T div S passes over all its blocks, and from one more pass as
    many blocks as the rest needs, the last in part. In each pass its slots map through a permutation of its own to
    whole blocks; the short last block comes last. Each slot draws its output shard by a seeded hash, so the slots of a
    source fall to the shards as one multinomial draw of all of them, and over all shards a source has its target exactly.
    """
    t = (sources.where("source_size > 0").withColumn("want", F.round("target").cast("long"))
         .withColumn("full", F.expr(f"source_size div {BLOCK}")).withColumn("tail", F.expr(f"source_size % {BLOCK}"))
         .withColumn("blocks", F.expr("full + if(tail > 0, 1, 0)"))
         .withColumn("passes", F.expr("want div source_size")).withColumn("rest", F.expr("want % source_size"))
         .withColumn("n_slots", F.expr(f"passes * blocks + (rest + {BLOCK - 1}) div {BLOCK}")))
    n_shards = F.greatest(F.lit(1), F.expr(f"all_slots div {SHARD_SLOTS}"))
    t = t.withColumn("all_slots", F.sum("n_slots").over(W.orderBy(F.lit(1)).rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing)))
    parts = t.where("n_slots > 0").withColumn("part", F.explode(F.expr(f"sequence(0, (n_slots - 1) div {SHARD_SLOTS})")))
    # A given number of partitions, since a part is one row before and thousands after; its size would merge them all.
    n_tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = (parts.repartition(n_tasks, "skey", "part").withColumn("slot", F.explode(F.expr(
        f"sequence(part * {SHARD_SLOTS}, least(n_slots, (part + 1) * {SHARD_SLOTS}) - 1)")))
        .withColumn("pass", F.expr("slot div blocks")).withColumn("k", F.expr("slot % blocks")))
    block = F.when(F.col("k") == F.col("full"), F.col("k")).otherwise(
        permuted(F.col("k"), F.col("full"), F.lit(SEED), F.col("skey"), F.col("pass")))
    whole = F.when(F.col("k") == F.col("full"), F.col("tail")).otherwise(F.lit(BLOCK))
    last = (F.col("pass") == F.col("passes")) & (F.col("k") == F.expr(f"rest div {BLOCK}"))
    return each.select(F.pmod(F.xxhash64(F.lit(SEED), "skey", "slot"), n_shards).alias("shard"), "skey", block.alias("block"),
                       F.when(last, F.expr(f"rest % {BLOCK}")).otherwise(whole).cast("long").alias("words"))


def taken_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sized documents, source table, and (rid, lo, n, shards) of the blocks that the mix takes.

    The first n[k] words of the row ``rid`` from its word ``lo`` on go to the output shard shards[k], for every k.
    ``docs`` has rid, doc_id, source and size.
    """
    keyed = docs.withColumn("skey", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))))
    sizes = keyed.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    sources = saved(targets(sizes).join(sizes.select("skey", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s")))
                    .drop("s"))
    blocks = slots(sources).groupBy("skey", "block").agg(
        F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("takes"))  # at most MOST + 1 takes of a block
    placed = _laid_out(keyed).where("size > 0").withColumn("block", F.explode(F.expr(
        f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")))
    first, end = F.greatest(F.col("start"), F.col("block") * BLOCK), F.least(
        F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    cut = placed.select("rid", "skey", "block", (first - F.col("start")).alias("lo"), (end - F.col("start")).alias("hi"),
                        (first - F.col("block") * BLOCK).alias("inside"))
    # The blocks grow with the corpus, which the planner cannot see behind the rows that make them: no broadcast.
    met = cut.join(blocks.hint("merge"), ["skey", "block"])
    spans = met.withColumn("n", F.transform("takes", lambda t: F.least(
        F.col("hi") - F.col("lo"), F.greatest(F.lit(0), t["words"] - F.col("inside")))))
    return keyed, sources, spans.select("rid", "lo", "n", F.col("takes.shard").alias("shards"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.size(words_of(F.col("text"))).cast("long")).withColumn(
        "rid", F.monotonically_increasing_id())


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and shards of every row of ``docs`` (doc_id, text, source).

    shards: (shard, taken) of the output shards that words of the row go to, by shard; their sum is taken.
    Null, empty and blank texts have size 0 and nothing is taken; a null source is a source of its own, last in order.
    Repeated rows are documents of their own; ties in the layout go by id and size, so reruns agree. An empty table
    gives no rows. No row is taken more than ``MOST`` times its size.
    """
    sized = saved(_sized(docs.select("doc_id", "text", "source")).drop("text"))
    keyed, sources, spans = taken_spans(sized)
    each = spans.select("rid", F.explode(F.arrays_zip("shards", "n")).alias("t")).where("t.n > 0")
    dealt = each.groupBy("rid", F.col("t.shards").alias("shard")).agg(F.sum("t.n").alias("taken"))
    taken = dealt.groupBy("rid").agg(F.sum("taken").alias("taken"),
                                     F.sort_array(F.collect_list(F.struct("shard", "taken"))).alias("shards"))
    none = F.array().cast(taken.schema["shards"].dataType)
    return (keyed.join(taken, "rid", "left").join(sources.select("skey", "source_size", "target"), "skey")
            .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
                    F.coalesce("shards", none).alias("shards")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: the words taken of each, in order, repeats after them.

    A document taken whole and once keeps its text as it is; one of which nothing is taken is not in the mix, which
    holds for documents without words. n_chars, where it is a column, follows the text.
    """
    inner = wrapped(docs, doc_id=F.col("doc_id"), text=F.col("text"), source=F.col("source"))
    stored = saved(_sized(inner))
    _, _, spans = taken_spans(stored.select("rid", "doc_id", "source", "size"))
    each = spans.select("rid", F.posexplode("n").alias("turn", "n"), "lo").where("n > 0")
    lists = each.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("turn", "lo", "n"))).alias("spans"),
                                    F.sum("n").alias("taken"))
    met = stored.join(lists, "rid").withColumn("words", words_of(F.col("text")))
    joined = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(
        F.col("words"), (s["lo"] + 1).cast("int"), s["n"].cast("int")))), " ")
    once = (F.col("taken") == F.col("size")) & F.forall("spans", lambda s: s["turn"] == 0)
    # A second use of the words keeps them a column; else each span would part the whole text again.
    joined = F.when(F.size("words") > 0, joined)
    out = met.withColumn("new", F.when(once, F.col("text")).otherwise(joined))
    change = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return out.select(*[change.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
