"""Connected components of a graph, whose nodes are of any ordered type, by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.sources.store import kept, scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each node's neighbours to the least of its neighbourhood: the larger ones (large), or the smaller ones and itself."""
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = kept(edges.unionByName(flipped) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    least = kept(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    tied = near.join(least, "a")
    moved = tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots: root is the least node it is connected with.

    Each round is stored, and rounds go on until one changes nothing; their number grows with the logarithm of the
    graph. A node with very many neighbours is summed up in each task before the shuffle, and its rows can be split
    between tasks in the join. Edges from a node to itself and repeated edges change nothing.
    """
    with scratch(edges.sparkSession):
        return kept(_roots(edges), lasting=True)


def _roots(edges: DataFrame) -> DataFrame:
    edges = kept(edges.filter("a != b").distinct())
    seen = None
    while True:
        edges = kept(_stars(_stars(edges, large=True), large=False))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("b", "a"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
