"""Distributed union-find: connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusops.llm.common import forget, materialise


def _to_min(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the smallest v of u or u itself; a hub's rows join one row, so skewed hubs can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    near = _to_min(edges)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _open_nodes(edges: DataFrame) -> int:
    """Nodes that have two parents, or a parent and a child: none when all components are stars."""
    sides = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    each = sides.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 or (up = 1 and down = 1)").count()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b), component being the smallest node that can be reached.

    Rounds go on until every component is a star, so a chain of n links takes on the order of log n rounds. Links of a
    node to itself and links with a null are ignored; repeated links and either direction are the same.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialise(edges.where("a is not null and b is not null and a <> b").distinct())
    while _open_nodes(edges):
        after = materialise(_small_star(_large_star(edges)))
        forget(edges)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
