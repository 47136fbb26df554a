"""Connected components of a link table by alternating star contraction, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _nearest(edges: DataFrame) -> DataFrame:
    """Each u with the least of itself and its neighbours v."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of comparable keys: rows (node, root) for every node that is linked; root is its least node.

    Each round hangs every node's larger neighbours on its least one, then its smaller ones. Rounds grow
    with the logarithm of the longest path; a star, whatever its size, takes two. Minima are taken before
    the shuffle, so a node with very many links is one row per task; every round is a written table.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _nearest(large)
        small = large.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, stored(small.unionByName(near.where("u <> m").select("u", F.col("m").alias("v"))).distinct(), "stars")
        del both, large, near, small
        discard(before)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node")).distinct().join(edges.select(F.col("u").alias("node")), "node", "left_anti")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
