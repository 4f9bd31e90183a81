"""Connected components by alternating stars; links and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.session import materialise


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of these. In links, a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    smaller = links.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return smaller.unionAll(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b: long); root is the smallest node reachable.

    Repeated links, links in both directions and links of a node to itself change nothing; nodes
    with no other neighbour are not returned; links with a null end are none. Each round is
    written to the shared folder. The number of rounds grows with the logarithm of the longest path.
    """
    now = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        now = materialise(_small_star(_large_star(now)), "stars")
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(now.select(F.col("a"), F.col("a")).distinct())
        state = tuple(found)
