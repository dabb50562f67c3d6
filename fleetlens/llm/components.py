"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import written


def _is_stars(edges: DataFrame) -> bool:
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    below = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return twice.unionByName(below).isEmpty()


def components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """(node, component) for every node that has an edge to another; the component is its smallest node.

    Each round hooks every node to the smallest node it knows of, so stars grow and paths halve. A round
    is written to the shared folder. The smallest neighbour of a hub is aggregated map-side and joined
    back, which Spark can split, so a hub costs no single task. Nulls and self-links are left out. It ends
    when every node hangs on one node that hangs on none.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v and u is not null and v is not null")
    edges = written(edges.distinct(), name)
    while not _is_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = written(small.distinct(), name)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
