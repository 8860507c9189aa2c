"""Numbering rows without ever holding a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(df: DataFrame, order: str, n: int | None = None) -> Column:
    """A column that cuts df into about n ranges of `order`, by quantiles of all rows (n numbers come to the driver)."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return F.lit(0)
    bounds = df.agg(F.percentile_approx(order, [k / n for k in range(1, n)], 1000)).first()[0]
    if not bounds:
        return F.lit(0)
    kind = df.schema[order].dataType
    sorted_bounds = F.array(*[F.lit(b).cast(kind) for b in sorted(set(bounds))])
    # its place among the bounds; a lambda here would end up in the self-join of running() with unbound columns
    place = F.array_position(F.sort_array(F.array_append(sorted_bounds, F.col(order))), F.col(order)) - 1
    return F.coalesce(place, F.lit(0)).cast("int")


def running(df: DataFrame, group: list[str], order: str, weight: Column, name: str, cut_by: Column | None = None) -> DataFrame:
    """Adds `name`: the sum of weight over the rows of the group up to and including this one.

    Each (group, range of order) is summed by itself; the few range sums are added up. `order` is a number that tells
    the rows of a group apart. cut_by: ranges() of an earlier call, to be used again.
    """
    # equal structs may hold nulls; as the window and the join have one key, rows are exchanged once
    cut = df.withColumn("_key", F.struct(*group, (ranges(df, order) if cut_by is None else cut_by).alias("_range"))).withColumn("_w", weight)
    sums = cut.groupBy("_key").agg(F.sum("_w").alias("_sum"))
    earlier = Window.partitionBy(*[F.col(f"_key.{g}") for g in group]).orderBy("_key._range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_key", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_key").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = cut.withColumn(name, F.sum("_w").over(inside)).join(bases, "_key")
    return found.withColumn(name, F.col(name) + F.col("_base")).select(*df.columns, name)


def numbered(df: DataFrame, group: list[str], order: str, name: str = "ordinal") -> DataFrame:
    """Adds `name`: 1, 2, ... in each group by order."""
    return running(df, group, order, F.lit(1).cast("long"), name)
