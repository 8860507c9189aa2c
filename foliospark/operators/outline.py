"""Outlines as adjacency rows: node, parent (null for a root). Depth is bounded, as outlines are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten_tree(nodes: DataFrame, depth: int) -> DataFrame:
    """Adds root, path (nodes joined by /) and depth (1 for a root); nodes deeper than `depth` are left out.

    One equi-join a level. `depth` is a small parameter: the reading limit for outlines.
    """
    level = nodes.where("parent IS NULL").select("*", F.col("node").alias("root"), F.col("node").alias("path"), F.lit(1).alias("depth"))
    found, rest = level, nodes.where("parent IS NOT NULL")
    for k in range(2, depth + 1):
        above = level.select(F.col("node").alias("parent"), F.col("root"), F.col("path").alias("_above"))
        level = rest.join(above, "parent").withColumn("path", F.concat("_above", F.lit("/"), "node")).withColumn("depth", F.lit(k)).select(*found.columns)
        found = found.unionByName(level)
    return found


def promote_children(nodes: DataFrame, gone: Column, depth: int) -> DataFrame:
    """Drops the nodes for which `gone` holds; their children move up to the nearest surviving ancestor."""
    marked = nodes.withColumn("_gone", gone)
    dead = marked.where("_gone").select(F.col("node").alias("_dead"), F.col("parent").alias("_up"))
    alive = marked.where("NOT _gone").drop("_gone")
    for _ in range(depth):
        alive = alive.join(dead, F.col("parent") == F.col("_dead"), "left").withColumn(
            "parent", F.when(F.col("_dead").isNotNull(), F.col("_up")).otherwise(F.col("parent"))
        ).drop("_dead", "_up")
    return alive
