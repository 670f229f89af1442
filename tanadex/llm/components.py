"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tanadex.llm.common import saved


def _large_star(links: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the least node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(moved).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node reachable.

    Each round writes its links to the shared folder, so no lineage grows and no executor's loss costs more than a
    round; the rounds grow with the logarithm of the longest chain. Only a count and a checksum reach the driver.
    Minimums are aggregated before they are shuffled, so a node with very many links is no hot group. Links with a
    null end are dropped; a link from a node to itself names a component of one node.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = saved(ends)
    lonely = now.where("a = b")
    now, before = now.where("a <> b"), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == before or seen[0] == 0:
            break
        before = seen
        now = saved(_small_star(_large_star(now)))
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    rest = lonely.select(F.col("a").alias("node")).join(leaves.unionByName(roots).select("node"), "node", "left_anti")
    return leaves.unionByName(roots).unionByName(rest.select("node", F.col("node").alias("root")))
