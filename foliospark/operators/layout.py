"""Lines, columns, cells and paragraphs from positioned runs.

Where each step compares with an element that an earlier step has kept or changed, no window frame can say it; these
folds run per page in Python. A page is one group: its size is bounded by what fits on a page.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, group: list[str], order: list, new: Column, name: str = "island") -> DataFrame:
    """Adds `name`: 1, 2, ...; a row for which `new` holds, or the first of the group, starts one."""
    w = Window.partitionBy(*group).orderBy(*order)
    flag = (F.coalesce(new, F.lit(True))).cast("long")
    return df.withColumn("_flag", flag).withColumn(name, F.sum("_flag").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_flag")


def clusters(df: DataFrame, group: list[str], value: str, tolerance: float) -> DataFrame:
    """1-D clusters: a new one where the gap to the next smaller value exceeds the tolerance."""
    w = Window.partitionBy(*group).orderBy(value)
    return islands(df, group, [value], F.col(value) - F.lag(value).over(w) > tolerance, "cluster")


def ascending_runs(df: DataFrame, group: list[str], order: str, value: str, least: int = 5) -> DataFrame:
    """Stacks of rising values: a new one when the value stops rising; those of `least` rows or more stay."""
    w = Window.partitionBy(*group).orderBy(order)
    runs = islands(df, group, [order], F.col(value) <= F.lag(value).over(w), "stack")
    n = Window.partitionBy(*group, "stack")
    return runs.withColumn("stack_rows", F.count(F.lit(1)).over(n)).where(F.col("stack_rows") >= least)


def merged_intervals(df: DataFrame, group: list[str], start: str, end: str, slack: float = 2.0, dealt: bool = False) -> DataFrame:
    """Intervals that overlap or lie within `slack` of what came before, merged: group, start, end, n.

    Equal intervals are one row with a count: where several begin one merged interval, no order among them could say which does.
    dealt: the rows are dealt out by a part of the group already and are not exchanged again."""
    once = (df if dealt else df.repartition(*group)).groupBy(*group, start, end).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    found = islands(once, group, [start, end], F.col(start) > F.max(end).over(w) + slack, "_i")
    return found.groupBy(*group, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_n").alias("n")).drop("_i")


def kept_stops(stops: Column, apart: float = 4.0) -> Column:
    """Sorted stops; each must lie more than `apart` beyond the last kept one."""
    start = F.array().cast("array<double>")
    return F.aggregate(
        F.array_sort(stops),
        start,
        lambda kept, x: F.when(F.size(kept) == 0, F.array(x)).when(x > F.get(kept, F.size(kept) - 1) + apart, F.concat(kept, F.array(x))).otherwise(kept),
    )


def cells(runs: DataFrame, group: list[str], share: float = 2.2) -> DataFrame:
    """Adds `cell`: a new one where the gap to the reach of the runs before exceeds `share` sizes."""
    w = Window.partitionBy(*group).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("x") + F.col("width")).over(w)
    return islands(runs, group, ["x"], F.col("x") - reach > share * F.col("size"), "cell")


def leading(lines: DataFrame, group: list[str], fallback: float = 1.2) -> DataFrame:
    """Per group: median of the gaps between baselines that are above 0 and at most 3 sizes; else 1.2 sizes."""
    w = Window.partitionBy(*group).orderBy(F.desc("y"))
    gaps = lines.withColumn("gap", F.lag("y").over(w) - F.col("y"))
    good = F.when((F.col("gap") > 0) & (F.col("gap") <= 3 * F.col("size")), F.col("gap"))
    return gaps.groupBy(*group).agg(F.coalesce(F.median(good), F.lit(fallback) * F.median("size")).alias("leading"))


def paragraphs(lines: DataFrame, group: list[str], ratio: float = 1.6) -> DataFrame:
    """Adds `paragraph`: a new one after a wide gap, a change of size by more than 1, or at a block opener.

    lines: group, line order by y descending, columns y, size, opens (boolean), leading.
    """
    w = Window.partitionBy(*group).orderBy(F.desc("y"))
    new = (
        (F.lag("y").over(w) - F.col("y") > ratio * F.col("leading"))
        | (F.abs(F.lag("size").over(w) - F.col("size")) > 1)
        | F.col("opens")
    )
    return islands(lines, group, [F.desc("y")], new, "paragraph")


def folded(rows: DataFrame, group: list[str], added: dict[str, str], fold: Callable[[pa.Table], list[np.ndarray]]) -> DataFrame:
    """The rows of each group with columns `added` (name: type), which `fold` works out from the whole group as an Arrow table."""

    def run(page: pa.Table) -> pa.Table:
        for name, values in zip(added, fold(page), strict=True):
            page = page.append_column(name, pa.array(values))
        return page

    schema = rows.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in added.items()]).schema
    return rows.groupBy(*group).applyInArrow(run, schema)


def _from_the_top() -> Callable[[pa.Table, str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A function, to be sent to the tasks by value: rows from the top down, then from the left, with their y and another column."""

    def from_the_top(page: pa.Table, other: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = page["y"].to_numpy().astype(float)
        order = np.lexsort((page["item"].to_numpy(), page["x"].to_numpy(), -y))
        return order, y[order], page[other].to_numpy().astype(float)[order]

    return from_the_top


def _placed() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function, to be sent to the tasks by value: values of ordered rows, back in the rows' own places."""

    def placed(order: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[order] = values
        return out

    return placed


def lines_by_overlap(boxes: DataFrame, group: list[str]) -> DataFrame:
    """Adds `line`: a box joins the first line with a member that it overlaps by half the smaller height or more.

    Boxes are taken from the top down, then from the left. Columns: x, y, width, height and item.
    """

    def fold(page: pa.Table) -> list[np.ndarray]:
        order, ys, hs = from_the_top(page, "height")
        # boxes one after another with the same y and height join the same line, so only the first of them is looked up
        new = np.ones(len(ys), dtype=bool)
        new[1:] = (ys[1:] != ys[:-1]) | (hs[1:] != hs[:-1]) | ~(hs[1:] >= 0)
        # as y falls, a member that begins above all that a later box can reach joins nothing more; heights below 0 shift that
        reach = float(np.nanmax(hs, initial=0.0)) + max(0.0, -0.5 * float(np.nanmin(hs, initial=0.0)))
        near: dict[int, dict[tuple[float, float], None]] = {}  # line: its members in reach, each box's bounds once
        leave: deque[tuple[float, int, tuple[float, float]]] = deque()
        firsts, lines = [], 0
        for y, h in zip(ys[new].tolist(), hs[new].tolist(), strict=True):
            while leave and leave[0][0] > y + reach:
                _, k, member = leave.popleft()
                del near[k][member]
                if not near[k]:
                    del near[k]
            for k in sorted(near):
                if any(min(y + h, b) - max(y, a) >= 0.5 * min(h, b - a) for a, b in near[k]):
                    break
            else:
                k = lines = lines + 1
                near[k] = {}
            if (y, y + h) not in near[k]:
                near[k][y, y + h] = None
                leave.append((y, k, (y, y + h)))
            firsts.append(k)
        return [placed(order, np.asarray(firsts, dtype=np.int64)[np.cumsum(new) - 1])]

    from_the_top, placed = _from_the_top(), _placed()
    return folded(boxes, group, {"line": "long"}, fold)


def lines_by_baseline(runs: DataFrame, group: list[str], share: float = 0.35) -> DataFrame:
    """Adds `line`: a run joins the current line while its baseline is within max(1.5, share * size) of the line's
    first run. Columns: x, y, size and item."""

    def fold(page: pa.Table) -> list[np.ndarray]:
        order, ys, sizes = from_the_top(page, "size")
        # a run with the baseline of the one before is in its line too
        new = np.ones(len(ys), dtype=bool)
        new[1:] = ys[1:] != ys[:-1]
        numbers, seed, n = [], None, 0
        for y, size in zip(ys[new].tolist(), sizes[new].tolist(), strict=True):
            if seed is None or abs(seed[0] - y) > max(1.5, share * seed[1]):
                seed, n = (y, size), n + 1
            numbers.append(n)
        return [placed(order, np.asarray(numbers, dtype=np.int64)[np.cumsum(new) - 1])]

    from_the_top, placed = _from_the_top(), _placed()
    return folded(runs, group, {"line": "long"}, fold)


def settled_numbers(pages: DataFrame, group: list[str]) -> DataFrame:
    """Adds `settled`: the printed number, or, where it is missing between two settled ones that differ by 2, the one
    between. The number before is the settled one, so gaps close in page order."""
    from pyspark.sql.types import LongType, StructField, StructType

    def fold(doc: pd.DataFrame) -> pd.DataFrame:
        doc = doc.sort_values("page", kind="stable")
        printed = [None if pd.isna(v) else int(v) for v in doc["printed"]]
        out: list[int | None] = []
        for k, v in enumerate(printed):
            before = out[-1] if out else None
            after = printed[k + 1] if k + 1 < len(printed) else None
            out.append(before + 1 if v is None and before is not None and after is not None and after - before == 2 else v)
        return doc.assign(settled=pd.array(out, dtype="Int64"))

    return pages.groupBy(*group).applyInPandas(fold, StructType([*pages.schema.fields, StructField("settled", LongType())]))


def vertical_settle(blocks: DataFrame, group: list[str]) -> DataFrame:
    """Adds `space_before` and `bottom`: blocks follow one another downwards; a block that would overlap the one above
    is pushed down. Columns: item, top (from the page's top), height."""

    def fold(page: pa.Table) -> list[np.ndarray]:
        order = np.argsort(page["item"].to_numpy(), kind="stable")
        at, space, bottoms = 0.0, [], []
        for top, height in zip(page["top"].to_numpy()[order].tolist(), page["height"].to_numpy()[order].tolist(), strict=True):
            gap = max(0.0, top - at)
            at = at + gap + height
            space.append(gap)
            bottoms.append(at)
        return [placed(order, np.asarray(space, dtype=float)), placed(order, np.asarray(bottoms, dtype=float))]

    placed = _placed()
    return folded(blocks, group, {"space_before": "double", "bottom": "double"}, fold)


def touching_components(rules: DataFrame, group: list[str], slack: float = 2.0) -> DataFrame:
    """Adds `component`: rules whose boxes, grown by `slack`, touch, directly or through others. Columns: item, x, y,
    width, height. A sweep per page over y, since most pages are longer than wide, with union-find."""

    def fold(page: pa.Table) -> list[np.ndarray]:
        x, y, width, height, item = (page[k].to_numpy() for k in ("x", "y", "width", "height", "item"))
        order = np.lexsort((item, x))
        x, y, width, height, item = (v[order] for v in (x, y, width, height, item))
        x0, x1, y0, y1 = x - slack, x + width, y - slack, y + height
        n = len(x)
        # pairs that meet across, found in the order of their lower edges; those among them that overlap along x too touch
        up = np.argsort(y0, kind="stable")
        behind = np.searchsorted(y0[up], y1[up], side="right")  # a rule meets those that begin up to its upper edge
        root = list(range(n))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for p in range(n):
            k, others = up[p], up[p + 1 : behind[p]]
            first, second = np.minimum(others, k), np.maximum(others, k)  # by x
            for j in others[(x1[first] >= x0[second]) & (y1[others] >= y0[others])].tolist():
                a, b = find(j), find(int(k))
                root[max(a, b)] = min(a, b)
        roots = np.array([find(k) for k in range(n)], dtype=np.int64)
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, roots, item)
        return [placed(order, least[roots])]

    placed = _placed()
    return folded(rules, group, {"component": "long"}, fold)


def word_alignment(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of two word lists."""
    n, m = len(left), len(right)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if left[i] == right[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if left[i] == right[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def aligned(items: DataFrame, pieces: DataFrame, group: list[str], item_order: list[str], piece_order: str, text: str = "text") -> DataFrame:
    """Two cuts of the same text, met by the letters and digits before them: each item's columns without the text, with
    the piece in which it starts and `straddles`, whether it goes on behind that piece.

    Blanks and signs may differ between the two. Items and pieces without a letter or digit take no part; an item behind
    the last piece gets none. One pass over both sides together, a group's rows in order.
    """
    letters = F.length(F.regexp_replace(F.col(text), "[^A-Za-z0-9]", "")).cast("long")

    def placed(side: DataFrame, order: list[str]) -> DataFrame:
        upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        some = side.withColumn("_n", letters).where("_n > 0").withColumn("_end", F.sum("_n").over(upto))
        return some.withColumn("_start", F.col("_end") - F.col("_n")).drop(text, "_n")

    left = placed(items, item_order)
    right = placed(pieces, [piece_order]).select(*group, "_start", F.struct(F.col(piece_order).alias("piece"), F.col("_end").alias("end")).alias("_piece"))
    both = left.withColumn("_item", F.lit(True)).unionByName(right.withColumn("_item", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy(*group).orderBy("_start", "_item").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_in", F.last("_piece", ignorenulls=True).over(before)).where("_item")
    inside = F.col("_start") < F.col("_in.end")
    return met.select(
        *[c for c in items.columns if c != text],
        F.when(inside, F.col("_in.piece")).alias("piece"),
        F.when(inside, F.col("_end") > F.col("_in.end")).alias("straddles"),
    )
