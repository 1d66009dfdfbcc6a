"""Connected components of a graph of links, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node in ``links`` (a, b: long); root is its component's smallest node.

    Rounds of large stars and small stars: each node links its larger neighbours, then its
    smaller ones, to the smallest in reach. The number of links never grows, chains halve, and
    what a round gathers by node is a minimum, so a hub is pre-aggregated before the shuffle.
    Minima and links are tables in the shared folder before they are joined: both sides of a join
    are then plain exchanges, and adaptive execution splits a hub's links over many tasks.
    No links give no nodes; nulls in a link drop it.
    """
    stars = shared_checkpoint(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = shared_checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = shared_checkpoint(large.filter("a <> b").distinct())
        least = shared_checkpoint(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        stars = shared_checkpoint(small.filter("a <> b").distinct())
        now = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = stars.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
