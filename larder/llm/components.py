"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import removed, written


def _unfinished(edges: DataFrame) -> bool:
    """Whether a node points to several others, or both points and is pointed at; else edges are stars around roots."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    odd = ends.groupBy("node").agg(F.sum("out").alias("n_out"), F.count(F.lit(1)).alias("n")).filter("n_out > 1 or (n_out > 0 and n > n_out)")
    return not odd.isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the smallest node that it reaches.

    Each round links neighbours to the smallest node near them, so a chain shortens by half or more; a round is
    written to the shared folder. No node's neighbours are gathered: only their minimum is, with partial sums.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    while _unfinished(now):
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v")
        before, now = now, written(small.distinct(), "edges")
        removed(before)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
