"""Connected components of a graph given as links between long node ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm.common import saved


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``links``; the root is the smallest node of its component.

    Large-star and small-star steps in turn until every link points at a root: the links
    halve their distance to the root in each round, so rounds grow with the logarithm of
    the longest path. Each round is a distributed job whose result is checkpointed; nothing
    but a yes or no reaches the driver. No links give no rows.
    """
    edges = saved(links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u <> v").distinct())
    while not stars(edges):
        # large star: the larger neighbours of a node are linked to its smallest neighbour
        both = edges.union(edges.select("u", "v").toDF("v", "u"))       # (v: centre, u: neighbour)
        least = both.groupBy("v").agg(F.min("u").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.least("m", "v").alias("u"))
        large = large.where("u <> v").distinct()
        # small star: a node's smaller neighbours and the node itself are linked to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).union(small.select("v", F.col("m").alias("u")))
        edges = saved(small.where("u <> v").distinct())
    roots = edges.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots)


def stars(edges: DataFrame) -> bool:
    """Every node links to one other only, and that one to none."""
    twice = edges.groupBy("v").count().where("count > 1").select("v")
    chained = edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi")
    return not twice.union(chained).limit(1).count()
