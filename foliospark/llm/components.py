"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(links: DataFrame) -> DataFrame:
    """links (a long, b long), in any direction, with or without repeats. Returns (node, component) for every node
    that has a link to another one; component is the smallest node that it reaches.

    Large-star ties each larger neighbour of a node to the node's smallest neighbour, small-star each smaller one; the
    link table never grows by more than the number of nodes, and a logarithmic number of rounds suffices. Every
    round is written to the shared folder; only counts and sums come to the driver.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = written(pairs, "links")
    state = None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.where("u <> v"), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done, pairs = pairs, written(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        discard(done)
        discard(large)
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = pairs.select("v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
