"""Paths of bounded length over an edge table.

A path never uses an edge twice (a trail).  The levels are unrolled joins, shortest first; with
``distinct`` only the least distance of each node is kept, so levels stay as small as the graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trails(starts: DataFrame, edges: DataFrame, depth: int, reverse: bool = False, least: int = 1) -> DataFrame:
    """(start, node, distance, path) for every trail of ``least`` to ``depth`` edges.

    ``starts`` has ``node``; ``edges`` have ``src`` and ``dst``, each pair once.  ``path`` is the
    array of its edges.  ``reverse`` walks from heads to tails.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to"), F.struct("src", "dst").alias("_edge"))
    edge_type = steps.schema["_edge"].dataType
    level = starts.select(F.col("node").alias("start"), "node", F.array().cast(f"array<{edge_type.simpleString()}>").alias("path"))
    levels = [level] if least == 0 else []
    for k in range(1, depth + 1):
        joined = level.join(steps, F.col("node") == F.col("_from"))
        if k > 1:
            joined = joined.where(~F.array_contains("path", F.col("_edge")))
        level = joined.select("start", F.col("_to").alias("node"), F.concat("path", F.array("_edge")).alias("path"))
        if k >= least:
            levels.append(level)
    if not levels:
        levels = [level.limit(0)]
    return reduce(DataFrame.unionByName, levels).select("start", "node", F.size("path").alias("distance"), "path")


def distances(starts: DataFrame, edges: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(start, node, distance): nodes that 1 to ``depth`` edges reach, by the least number.

    A start is among them only if a way leads back to it.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to"))
    frontier = starts.select(F.col("node").alias("start"), "node").distinct()
    found = None
    for k in range(1, depth + 1):
        reached = frontier.join(steps, F.col("node") == F.col("_from")).select("start", F.col("_to").alias("node")).distinct()
        if found is not None:
            reached = reached.join(found.select("start", "node"), ["start", "node"], "left_anti")
        level = reached.withColumn("distance", F.lit(k))
        found = level if found is None else found.unionByName(level)
        frontier = reached
    if found is None:
        return frontier.withColumn("distance", F.lit(0)).limit(0)
    return found
