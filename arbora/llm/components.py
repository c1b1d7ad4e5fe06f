"""Connected components of a link table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arbora.llm.common import written


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node has at most one smaller neighbour and no node has both sides."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): for each id of ``links`` (a, b) the smallest id that it reaches.

    Links may repeat, point either way or to themselves. Each round works on edges
    from a node to a smaller one; minima are aggregated before they are joined back,
    so a node with very many links costs no task more than its share.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while not _is_star_forest(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
