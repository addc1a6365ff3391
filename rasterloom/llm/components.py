"""Connected components of an edge table by alternating large-star and small-star steps, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """m: the least node among u and its neighbours (partial minima first, so that a node of very many edges costs little)."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the least node reachable.

    Each round is two joins over the edges left, written to the checkpoint folder; the rounds grow with the
    logarithm of the longest chain. It ends when a round changes no edge. Self loops and repeated edges are allowed.
    """
    edges = cut_lineage(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: larger neighbours of u hang on the least of u's neighbourhood.
        large = both.where(F.col("v") > F.col("u")).join(_min_neighbour(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours hang on the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut_lineage(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
