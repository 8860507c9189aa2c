"""Nested marks as a relation: which mark is in force for each text between begin and end markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def marks_in_force(items: DataFrame, key: list[str], order: str) -> DataFrame:
    """The text items with `mark`: the id of the innermost open mark that has one, null if none.

    items: key, order (a number), kind ('begin', 'end' or 'text'), id (of a begin, may be null), and other columns. An end closes
    the last open begin, whatever it is; one with nothing open does nothing; begins may stay open.

    A stack without a stack: the depth behind an item is the running sum of begins less ends, less its running minimum where
    that is below 0. At one depth, an end closes the begin before it. Begins that have no id are then left out of a second depth,
    at which the last begin is the one in force. Three windows over a page's items; the last two split a page by depth.
    """
    c = F.col
    w = Window.partitionBy(*key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(c("kind") == "begin", 1).when(c("kind") == "end", -1).otherwise(0)
    summed = items.withColumn("_sum", F.sum(step).over(upto))
    deep = summed.withColumn("_depth", c("_sum") - F.least(F.lit(0), F.min("_sum").over(upto)))
    before = F.coalesce(F.lag("_depth").over(w), F.lit(0))
    # the level that a begin opens or an end closes; 0: an end that closes nothing
    levelled = deep.withColumn("_level", F.when(c("kind") == "begin", c("_depth")).when(c("kind") == "end", before))
    same = Window.partitionBy(*key, "_level").orderBy(order)
    named = c("id").isNotNull()
    closes = F.lag((c("kind") == "begin") & named).over(same)
    inner = F.when((c("kind") == "begin") & named, 1).when((c("kind") == "end") & (c("_level") > 0) & closes, -1).otherwise(0)
    second = levelled.withColumn("_inner", inner).withColumn("_depth", F.sum("_inner").over(upto))
    level = Window.partitionBy(*key, "_depth").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when((c("kind") == "begin") & named, c("id")), ignorenulls=True).over(level)
    found = second.withColumn("mark", F.when(c("_depth") > 0, last)).where(c("kind") == "text")
    return found.drop("_sum", "_depth", "_level", "_inner", "kind", "id")
