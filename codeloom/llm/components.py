"""Connected components of a link table, distributed.

Large-star and small-star rounds (Kiveris et al., 2014) until all links form stars; every round
is a written table in the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _nearest(edges: DataFrame) -> DataFrame:
    """For each node the least of itself and its neighbours; sums partially, so hubs are cheap."""
    return edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _nearest(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether distinct links (u, v) all lead to a root: none leaves one node twice or goes on."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("end"))
    degrees = ends.groupBy("end.node").agg(F.sum("end.out").alias("out"), F.max("end.into").alias("into"))
    return degrees.where((F.col("out") > 1) | (F.col("out") > 0) & (F.col("into") > 0)).isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link; the root is the least node of its component.

    Links of a node with itself or with null are none; repeated links count once; no links give no rows.
    """
    spark = links.sparkSession
    path = common.scratch_path(spark, "links")
    edges = common.written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "links", path)
    while not _stars(edges):
        nxt = common.scratch_path(spark, "links")
        after = common.written(_small_star(_large_star(edges)), "links", nxt)
        common.drop_path(spark, path)
        path, edges = nxt, after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
