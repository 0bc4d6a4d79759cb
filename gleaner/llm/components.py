"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut_counted, cut_small


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """One step. `pairs` (u, v): for a large star all neighbours v of u, for a small one those below u."""
    least = cut_small(pairs.groupBy("u").agg(F.min("v").alias("_m")))  # cut, so that both sides are plain shuffles and AQE splits a hot node's partition
    met = pairs.join(least, "u").withColumn("_m", F.least("_m", "u"))
    if large:
        return met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("_m").alias("b")).distinct()
    out = met.select(F.col("v").alias("a"), F.col("_m").alias("b")).union(met.select(F.col("u").alias("a"), F.col("_m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def _is_forest(e: DataFrame) -> bool:
    """Whether `e` (a, b) are stars: each a has one b, which is no a. Steps leave those as they are, and nothing else."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter(F.col("up") + F.col("down") > 1).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b) but the roots; root is the least node that it reaches.

    Edges with nulls or of a node to itself don't count. Each step is cut off in the checkpoint folder.
    Neighbour minima are aggregated before they are shuffled, and a hot node's, as the root of a large
    component is one, are split by the adaptive skew join; no node's neighbours meet in one task's memory.
    """
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, n = cut_counted(e)
    while n and not _is_forest(e):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        e = cut_small(_stars(both, True))
        e = cut_small(_stars(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
