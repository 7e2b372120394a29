"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u").toDF("u", "v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of an undirected graph -> (node, root), root the smallest node of the component.

    Only nodes with an edge to another node appear. Null ends and loops are ignored, repeated edges count once; an
    empty edge table gives an empty result. Each round is an aggregate and a join on the node, so a node with very
    many edges is pre-aggregated and its join can be split; every round is written to the shared folder.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = saved(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    while not _stars(e):
        after = saved(_small_star(_large_star(e)), "cc")
        forget(e)
        e = after
    return e.toDF("node", "root")


def _stars(e: DataFrame) -> bool:
    """Whether every node points to one root, which itself points nowhere."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not ends.where("out > 1 or (out = 1 and into = 1)").limit(1).count()
