"""Aggregates that Spark has no function for."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of points that are in a task's memory at once, unless a single column has more.
MOST_PAIRS = 1 << 20


def floor_quantiles(df: DataFrame, group: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Per group the element at min(n - 1, floor(q * n)) of the sorted values; no interpolation.

    Works on (group, value, count) rows with running counts, so equal values are one row and none is gathered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group).orderBy(value)
    upto = counts.withColumn("_upto", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(group)))
    picks = []
    for name, q in quantiles.items():
        rank = F.least(F.floor(F.lit(q) * F.col("_n")), F.col("_n") - 1)
        picks.append(F.min(F.when(F.col("_upto") > rank, F.col(value))).alias(name))
    return upto.groupBy(group).agg(*picks)


def weighted_median(df: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """Per group the first value at which twice the running weight reaches the total."""
    sums = df.groupBy(group, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(group).orderBy(value)
    upto = sums.withColumn("_upto", F.sum("_w").over(w)).withColumn("_all", F.sum("_w").over(Window.partitionBy(group)))
    return upto.where(2 * F.col("_upto") >= F.col("_all")).groupBy(group).agg(F.min(value).alias(value))


def weighted_mode(df: DataFrame, group: str, key: str, weight: str) -> DataFrame:
    """Per group the key with the most weight (the smallest of equal ones) and its share."""
    sums = df.groupBy(group, key).agg(F.sum(weight).alias("_w"))
    best = sums.groupBy(group).agg(F.max("_w").alias("_top"), F.sum("_w").alias("_all"))
    top = sums.join(best, group).where(F.col("_w") == F.col("_top"))
    return top.groupBy(group).agg(F.min(key).alias(key), (F.first("_top") / F.first("_all")).alias("share"))


def otsu(histogram: DataFrame, group: str, bucket: str, count: str) -> DataFrame:
    """Per group the bucket after which a split of the histogram has the largest between-class variance."""
    w = Window.partitionBy(group).orderBy(bucket)
    whole = Window.partitionBy(group)
    h = histogram.select(
        group, bucket, F.sum(count).over(w).alias("w0"), F.sum(F.col(bucket) * F.col(count)).over(w).alias("s0"),
        F.sum(count).over(whole).alias("n"), F.sum(F.col(bucket) * F.col(count)).over(whole).alias("s"),
    ).where("w0 < n")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("n") - F.col("w0"))
    v = h.withColumn("v", F.col("w0").cast("double") * (F.col("n") - F.col("w0")) * gap * gap)
    return v.groupBy(group).agg(F.min_by(bucket, F.struct((-F.col("v")).alias("a"), F.col(bucket).alias("b"))).alias("threshold"))


def _fits(x: np.ndarray, y: np.ndarray, share: float, least: int) -> tuple[np.ndarray, ...]:
    """pitch (NaN for none), first, kept, refitted of columns with the same number of points each; a row is a column, by x."""
    pairs = np.triu_indices(x.shape[1], 1)
    apart = x[:, pairs[1]] - x[:, pairs[0]]
    with np.errstate(divide="ignore", invalid="ignore"):
        falls = np.where(apart > 0, (y[:, pairs[0]] - y[:, pairs[1]]) / apart, np.nan)
    falls.sort(axis=1)
    n, row = (apart > 0).sum(axis=1), np.arange(len(x))
    # without two places all are NaN, and so is the pitch
    pitch = (falls[row, np.maximum(n - 1, 0) // 2] + falls[row, n // 2]) / 2
    at_one = np.sort(y + (x - 1) * pitch[:, None], axis=1)
    first = (at_one[:, (x.shape[1] - 1) // 2] + at_one[:, x.shape[1] // 2]) / 2
    near = np.round(np.abs(first[:, None] - (x - 1) * pitch[:, None] - y) - share * np.abs(pitch)[:, None], 6) <= 0
    kept = near.sum(axis=1)
    refitted = (kept >= least) & (pitch > 0)
    total = lambda v: np.cumsum(np.where(near, v, 0.0), axis=1)[:, -1]  # noqa: E731  (one by one, as a fold adds them)
    with np.errstate(divide="ignore", invalid="ignore"):
        mx, my = total(x) / kept, total(y) / kept
        fall = -total((x - mx[:, None]) * (y - my[:, None])) / total((x - mx[:, None]) ** 2)
    fitted = refitted & np.isfinite(fall)
    return np.where(fitted, fall, pitch), np.where(fitted, my + fall * (mx - 1), first), kept, refitted


def _fitted(share: float, least: int) -> Callable[[pa.Array, pa.Array], pa.Array]:
    def fit(x: pa.Array, y: pa.Array) -> pa.Array:
        xs, ys = (side.flatten().to_numpy(zero_copy_only=False) for side in (x, y))
        sizes = pc.list_value_length(x).to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        out = [np.full(len(sizes), np.nan), np.zeros(len(sizes)), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)]
        for n in np.unique(sizes):
            if n < 2:
                continue
            same = np.flatnonzero(sizes == n)
            for own in np.array_split(same, len(same) * n * n // MOST_PAIRS + 1):
                at = starts[own][:, None] + np.arange(n)
                for column, values in zip(out, _fits(xs[at], ys[at], share, least), strict=True):
                    column[own] = values
        found = np.flatnonzero(~np.isnan(out[0]))
        rows = pa.StructArray.from_arrays([pa.array(column[found]) for column in out], ["pitch", "first", "kept", "refitted"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(found, np.arange(len(sizes) + 1)), pa.int32()), rows)

    return fit


def robust_fit(df: DataFrame, group: list[str], x: str, y: str, share: float = 0.5, least: int = 10) -> DataFrame:
    """Per group the line through falling points: pitch (fall for each step of x), first (y at x = 1), kept, refitted.

    The first estimate is the median of the slopes of all pairs of points and of where each point puts x = 1. Points more
    than share * pitch off are left out; if `least` or more remain, they are fitted again by least squares, otherwise the
    first estimate stands, as it does without a positive pitch. A group is one column of numbers with one point for each x:
    its pairs stay in its row, so a caller takes one point for each of a bounded range of x. Groups of one point are left out,
    and so are points without an x or y. Columns of as many points are taken together.
    """
    point = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group).agg(F.sort_array(F.collect_list(point)).alias("_p"))
    fit = F.arrow_udf(_fitted(share, least), "array<struct<pitch: double, first: double, kept: long, refitted: boolean>>")
    return points.select(*group, F.inline(fit(F.col("_p.x"), F.col("_p.y"))))
