"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblake.llm.blocks import join_split
from weblake.llm.storage import dropped, stored


def _only_stars(edges: DataFrame) -> bool:
    """Whether every larger end points at one node, and that node at none."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("outs"), F.lit(0).alias("ins")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("outs"), F.lit(1).alias("ins")))
    nodes = ends.groupBy("id").agg(F.sum("outs").alias("outs"), F.max("ins").alias("ins"))
    return nodes.where("outs > 1 or (outs = 1 and ins = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest id that each node reaches: ``id`` and ``component``, for all nodes of ``edges``.

    edges: ``a`` and ``b`` (long), in any direction, with repeats. Alternating stars: each node points
    its larger neighbours, then its smaller ones, to the smallest of them, until every node points
    at its component's smallest. Rounds grow with the logarithm of the longest chain, each a few
    aggregations and joins over at most as many edges as before; no node's neighbours are gathered.
    """
    one = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(one)
    while not _only_stars(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # A node may have a third of all others as neighbours: its row goes to them, they do not gather.
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = join_split(both, least, "u", "n").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = stored(small.where("a <> b").distinct())
        dropped(now, least, large)
        now = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
