"""Connected components of an edge table, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import dropped, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Large-star and small-star steps alternate until the edges are a forest of stars whose
    centres are the components; every step only joins and aggregates. The edges of a hub are
    summed before a shuffle; a join reads them, two numbers each, in one task. Each round is
    written to the shared folder, and the one before it goes."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    while not _is_forest_of_stars(e):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = written(small.union(least).distinct(), "small-star")
        dropped(e, large)
        e = small
    out = written(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct()), "components")
    dropped(e)
    return out


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """True if every node has one edge down at most and no centre has any."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    g = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return g.where("down > 1 or (down = 1 and up = 1)").isEmpty()
