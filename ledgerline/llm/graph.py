"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected ``edges`` (a, b): the
    root is the smallest node of its component.

    Each round is a handful of partially aggregated shuffles and ends in a
    reliable checkpoint; the number of rounds grows with the logarithm of a
    component's diameter.  The end is a forest of stars that a round leaves
    unchanged.  Loops (a = b) and repeated edges are allowed.
    """
    flip = lambda e: e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while True:
        # Large star: of each node's neighbours, the larger ones point to the least of all (or the node).
        both = now.union(flip(now))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a node and its smaller neighbours point to the least of them.
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.where("a <> b").union(least.select("u", "m")).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _state(edges: DataFrame) -> tuple:
    """Number and order-free hash of the edges."""
    row = edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))
    ).first()
    return tuple(row)
