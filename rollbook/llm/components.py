"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import stored_once


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it knows of."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    kin = down.join(least, "u").filter("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return kin.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Whether each node that points points once, and to one that does not point."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("points")).union(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("points"))
    )
    each = ends.groupBy("node").agg(F.sum("points").alias("out"), F.min("points").alias("least"))
    return each.filter("out > 1 or (out = 1 and least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node that an edge (a, b) names.

    Each round is written to the shared folder; the rounds end when every node points
    at the smallest of its component. Minima reduce before the shuffle, so a node with
    very many links is one row a task there; no node's links are collected.
    """
    now = edges.select("a", "b")
    alone = now.filter("a = b").select(F.col("a").alias("node"))
    while True:
        now = stored_once(edges.sparkSession, _small_star(_large_star(now)).distinct(), "edges")
        if _settled(now):
            break
    roots = now.select(F.col("b").alias("node")).union(alone).distinct().join(now.select(F.col("a").alias("node")), "node", "left_anti")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
