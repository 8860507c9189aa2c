"""Named destinations: names in a tree of nodes, resolved to pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A power of two: names of nodes further below the root are not found.
MOST_DEPTH = 32


def depths(kids: DataFrame, roots: DataFrame, key: list[str]) -> DataFrame:
    """(key, node, depth, path): nodes that hang under their root by MOST_DEPTH links at most, with the ordinals on the way.

    kids: key, node, ordinal, kid. roots: key, node. By pointer jumping from below: each round doubles how far up a node has been
    followed, so five rounds do for 32 levels, whatever the number of nodes. Nodes in a cycle never come to the root. Of several
    ways as long to the same node, the first in reading order stays.
    """
    base = roots.select(*key, "node").distinct()
    # where a link leads up to; the root has none
    up = kids.select(*key, F.col("kid").alias("node"), F.col("node").alias("top"), F.lit(1).alias("depth"), F.array(F.col("ordinal").cast("long")).alias("path"))
    up = up.join(base.select(*key, F.col("node")), [*key, "node"], "left_anti")
    top = base.select(*key, F.col("node").alias("top"), F.lit(True).alias("done"))
    up = up.join(top, [*key, "top"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
    reach = 1
    while reach < MOST_DEPTH:
        above = up.select(*key, F.col("node").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"), F.col("path").alias("before"), F.col("done").alias("ended"))
        jumped = up.where(~F.col("done")).join(above, [*key, "top"]).select(
            *key, "node", F.col("next").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), F.concat("before", "path").alias("path"), F.col("ended").alias("done")
        )
        kept = up.where("done").select(*key, "node", "top", "depth", "path", "done")
        up = kept.unionByName(jumped).groupBy(*key, "node", "top", "depth", "done").agg(F.min("path").alias("path"))
        reach *= 2
    found = up.where(F.col("done") & (F.col("depth") <= MOST_DEPTH)).select(*key, "node", "depth", "path")
    return found.unionByName(base.select(*key, "node", F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("path")))


def destinations(items: DataFrame, names: DataFrame, kids: DataFrame, roots: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """(columns of items, page): the page that each item's name leads to; 1 if the name is not in the tree, stands too deep or in a
    cycle, or if its target is no page.

    items: key, name. names: key, node, ordinal, name, target. pages: key, target, page. A name that stands several times counts
    where the tree is read first: a node's own names before those of its kids, kids in order.
    """
    placed = names.withColumnRenamed("ordinal", "place").join(depths(kids, roots, key), [*key, "node"])
    first = placed.groupBy(*key, "name").agg(F.min(F.struct("path", "place", "target"))["target"].alias("target"))
    found = first.join(pages.select(*key, "target", "page"), [*key, "target"], "left").select(*key, "name", "page")
    return items.join(found, [*key, "name"], "left").withColumn("page", F.coalesce(F.col("page"), F.lit(1)))
