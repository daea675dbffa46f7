"""Connected components of an edge table, each labelled by its smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import written


def _directed(pairs: DataFrame) -> DataFrame:
    """Distinct (hi, lo) pairs with hi > lo."""
    return pairs.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of undirected (a, b) edges; ``component`` is its smallest reachable node.

    Stars are formed in turns: every neighbour of a node that is larger than the node is moved to the smallest node
    around it, then every smaller one. The number of rounds grows with the logarithm of the longest chain. Each round is
    written, so a lost executor repeats one round; only the number and a checksum of the edges reach the driver.
    """
    current = written(_directed(edges))
    before = None
    while True:
        # Large stars: the larger neighbours of each node move to the smallest node of its neighbourhood.
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _directed(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        # Small stars: the node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").select(F.col("lo").alias("a"), F.col("m").alias("b"))
        small = moved.unionByName(least.select(F.col("hi").alias("a"), F.col("m").alias("b")))
        current = written(_directed(small))
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    # Now each node but the smallest has one edge, to the smallest.
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
