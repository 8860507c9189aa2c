"""Ruled tables: drawn rules to drawings, edges, grids and borders, and the text lines that sit in their cells.

Everything is keyed by page. Spark deals rules, text and frames out by page and gathers a page as one row; many pages at a time,
their rules and cells end to end in flat arrays, are then worked on by numpy. y grows upwards, and distances are in points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..sources.tables import by_page

# Fixed values of the format.
SAME_EDGE, MOST_THICK, LEAST_LONG = 2.0, 3.0, 8.0
DRAWN_SHARE, LEAST_EDGES, LEAST_COLUMN = 0.8, 3, 12.0
CELL_SLACK, FRAME_SLACK = 2.0, 18.0

#: Pairs of rules that are in a task's memory at once, and rules and text cells of the pages that are taken together.
MOST_PAIRS, MOST_ROWS = 1 << 20, 1 << 18


def _drawings(x: np.ndarray, y: np.ndarray, right: np.ndarray, top: np.ndarray) -> np.ndarray:
    """For pages with the same number of rules each, a row a page: the first place among the rules that each is joined with."""
    pages, n = x.shape
    meets = lambda low, high: low[:, :, None] - SAME_EDGE <= high[:, None, :]
    touch = meets(x, right) & meets(y, top)
    touch &= touch.transpose(0, 2, 1)
    first = np.broadcast_to(np.arange(n), (pages, n))
    while True:
        # the least place in reach, then that one's own; rounds fall off with the length of a chain doubling
        least = np.where(touch, first[:, None, :], first[:, :, None]).min(axis=2)
        least = np.take_along_axis(least, least, axis=1)
        if (least == first).all():
            return first
        first = least


def _chained(x: np.ndarray, y: np.ndarray, right: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The same for a page of many rules, a rule at a time: no table of its pairs is made."""
    first, free = np.full(len(x), -1), np.ones(len(x), bool)
    for seed in range(len(x)):
        if not free[seed]:
            continue
        front, free[seed] = [seed], False
        while front:
            r = front.pop()
            first[r] = seed
            near = np.flatnonzero(free & (x - SAME_EDGE <= right[r]) & (x[r] - SAME_EDGE <= right) & (y - SAME_EDGE <= top[r]) & (y[r] - SAME_EDGE <= top))
            free[near] = False
            front += near.tolist()
    return first


def _firsts(sizes: np.ndarray, left: np.ndarray, low: np.ndarray, right: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The place on its page of the first rule of each rule's drawing; sizes: rules of each page. Pages of as many rules are taken together."""
    starts, sides = np.cumsum(sizes) - sizes, (left, low, right, top)
    first = np.zeros(len(left), np.int32)
    for n in np.unique(sizes[sizes > 0]):
        same = np.flatnonzero(sizes == n)
        if n * n > MOST_PAIRS:
            for s in starts[same]:
                first[s : s + n] = _chained(*(v[s : s + n] for v in sides))
            continue
        for own in np.array_split(same, len(same) * n * n // MOST_PAIRS + 1):
            at = starts[own][:, None] + np.arange(n)
            first[at] = _drawings(*(v[at] for v in sides))
    return first


@F.arrow_udf(ArrayType(IntegerType()))
def _first_rules(x: pa.Array, y: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """The place of the first rule of each rule's drawing, by page."""
    sizes = pc.list_value_length(x).to_numpy(zero_copy_only=False)
    left, low, wide, high = (side.flatten().to_numpy(zero_copy_only=False) for side in (x, y, width, height))
    first = _firsts(sizes, left, low, left + wide, low + high)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(first))


def drawings(rules: DataFrame, key: list[str]) -> DataFrame:
    """Adds `drawing`: the smallest rule number among those that a rule touches, directly or by way of others.

    Rules touch when their boxes, widened by SAME_EDGE, meet. Pages of as many rules are taken together.
    """
    rule = F.struct("rule", "x", "y", "width", "height")
    page = rules.groupBy(*key).agg(F.sort_array(F.collect_list(rule)).alias("all"))
    page = page.withColumn("first", _first_rules("all.x", "all.y", "all.width", "all.height"))
    own = F.zip_with("all", "first", lambda r, at: F.struct(F.get("all", at)["rule"].alias("drawing"), *[r[c].alias(c) for c in ("rule", "x", "y", "width", "height")]))
    # behind the function pages are dealt out anew, each as one row; what follows by page or drawing exchanges nothing
    return by_page(page.select(*key, own.alias("own")), *key).select(*key, F.inline("own"))


def _pairs(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """As complex numbers, which numpy orders by the first part and then by the second."""
    both = np.empty(len(group), np.complex128)
    both.real, both.imag = group, value
    return both


def _among(group: np.ndarray, value: np.ndarray, of: np.ndarray, x: np.ndarray, side: str) -> np.ndarray:
    """Where each x would stand in its group `of`, as by searchsorted; value is sorted by group and value, without NaN."""
    return np.searchsorted(_pairs(group, value), _pairs(of, x), side)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of counts.sum() rows: the place that it is of, and its own place there."""
    own = np.repeat(np.arange(len(counts)), counts)
    return own, np.arange(len(own)) - (np.cumsum(counts) - counts)[own]


def _breaks(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _overlap(lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, np.minimum(hi, b) - np.maximum(lo, a))


class _Edges(NamedTuple):
    """Edges by drawing, upright ones first, and place: drawing, level, at; and the spans that are drawn of them: edge, lo, hi."""

    drawing: np.ndarray
    level: np.ndarray
    at: np.ndarray
    edge: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


class _Grids(NamedTuple):
    """Grids: the drawing of each; its row edges from the top and its column edges from the left, with the number of each grid's."""

    drawing: np.ndarray
    rows: np.ndarray
    n_rows: np.ndarray
    columns: np.ndarray
    n_columns: np.ndarray


def _edges(drawing: np.ndarray, x: np.ndarray, y: np.ndarray, width: np.ndarray, height: np.ndarray) -> _Edges:
    """Rules of a drawing that lie within SAME_EDGE of an edge's first one, at `at`, are one edge; what they draw of it is merged where
    it meets or lies within SAME_EDGE. Level edges have `at` as y, upright ones as x.

    Thick rules are panels and short ones are ticks; they belong to a drawing but are no edges.
    """
    level = (height <= MOST_THICK) & (width >= LEAST_LONG)
    own = np.flatnonzero(level | ((width <= MOST_THICK) & (height >= LEAST_LONG)))
    drawing, level, x, y, width, height = (v[own] for v in (drawing, level, x, y, width, height))
    mark = np.where(level, y + height / 2, x + width / 2)
    lo, hi = np.where(level, x, y), np.where(level, x + width, y + height)
    group = drawing * 2 + level
    order = np.lexsort((mark, group))
    group, mark, lo, hi = (v[order] for v in (group, mark, lo, hi))
    # from each group's first mark to the next one that is no more within its edge, in all groups in step
    after, end = _among(group, mark, group, mark + SAME_EDGE, "right"), np.searchsorted(group, group, "right")
    kept, now = np.zeros(len(mark), bool), _breaks(group)
    while len(now):
        kept[now] = True
        now = after[now][after[now] < end[now]]
    edge = np.cumsum(kept) - 1
    stops = np.flatnonzero(kept)
    order = np.lexsort((hi, lo, edge))
    edge, lo, hi = edge[order], lo[order], hi[order]
    values, rank = np.unique(hi, return_inverse=True)
    reach = np.maximum.accumulate(edge * (len(hi) + 1) + rank)
    fresh = np.ones(len(lo), bool)
    before = reach[:-1] - edge[1:] * (len(hi) + 1)  # negative: of another edge
    fresh[1:] = (before < 0) | (lo[1:] > values[np.maximum(before, 0)] + SAME_EDGE)
    at = np.flatnonzero(fresh)
    return _Edges(group[stops] // 2, group[stops] % 2 == 1, mark[stops], edge[at], lo[at], np.maximum.reduceat(hi, at) if len(at) else hi)


def _grids(edges: _Edges) -> _Grids:
    """Drawings that are grids.

    The widest level edge (of two, the lower) gives the width; level edges that cover it are row edges, from the top. Upright
    edges that cover the height and leave columns of LEAST_COLUMN are column edges, beside the two sides. Fewer than
    LEAST_EDGES of either make no grid.
    """
    starts = _breaks(edges.drawing)
    own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(edges.drawing))))
    left, right, top, bottom = np.full((4, len(starts)), np.nan)
    spans = np.searchsorted(edges.edge, np.arange(len(own)))
    first = edges.lo[spans]
    last = np.maximum.reduceat(edges.hi, spans) if len(spans) else first
    widest = np.lexsort((-edges.at, last - first, own))
    widest = widest[edges.level[widest]]
    left[own[widest]], right[own[widest]] = first[widest], last[widest]  # the last one of each drawing stays

    def covers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        of = own[edges.edge]
        drawn = np.bincount(edges.edge, _overlap(edges.lo, edges.hi, a[of], b[of]), len(own))
        return (b > a)[own] & (drawn >= (DRAWN_SHARE * (b - a))[own])

    rows = np.flatnonzero(edges.level & covers(left, right))
    top[own[rows]], bottom[own[rows[::-1]]] = edges.at[rows], edges.at[rows[::-1]]
    whole = np.flatnonzero(~edges.level & (right[own] - edges.at >= LEAST_COLUMN) & covers(bottom, top))
    place = _spread(np.bincount(own[whole], minlength=len(starts)))[1]
    end, columns = left.copy(), np.zeros(len(own), bool)
    by_place = np.argsort(place, kind="stable")
    for step in np.split(by_place, np.flatnonzero(np.diff(place[by_place])) + 1):
        at = whole[step]
        at = at[edges.at[at] - end[own[at]] >= LEAST_COLUMN]
        columns[at] = True
        end[own[at]] = edges.at[at]
    n_rows, n_columns = np.bincount(own[rows], minlength=len(starts)), np.bincount(own[columns], minlength=len(starts)) + 2
    grid = np.flatnonzero((n_rows >= LEAST_EDGES) & (n_columns >= LEAST_EDGES))
    is_grid = np.isin(np.arange(len(starts)), grid)
    rows = rows[is_grid[own[rows]]]
    rows = rows[np.lexsort((-edges.at[rows], own[rows]))]
    columns &= is_grid[own]
    of, at = np.concatenate([grid, own[columns], grid]), np.concatenate([left[grid], edges.at[columns], right[grid]])
    return _Grids(edges.drawing[starts[grid]], edges.at[rows], n_rows[grid], at[np.lexsort((at, of))], n_columns[grid])


def _sides(edges: _Edges, grids: _Grids, level: bool) -> np.ndarray:
    """For each row edge (level) or column edge of each grid, and each band across it, whether it is drawn there: the edge at its
    place, within SAME_EDGE, the first of several, covers DRAWN_SHARE of it."""
    lines, n_lines, bands, n_bands = grids.rows, grids.n_rows, grids.columns, grids.n_columns
    if not level:
        lines, n_lines, bands, n_bands = bands, n_bands, lines, n_lines
    own = np.flatnonzero((edges.level == level) & np.isin(edges.drawing, grids.drawing))
    group, at = np.searchsorted(grids.drawing, edges.drawing[own]), edges.at[own]
    of = np.repeat(np.arange(len(n_lines)), n_lines)
    found, place = np.full(len(lines), -1), _among(group, at, of, lines - SAME_EDGE, "left")
    for near in (place + 1, place, place - 1):
        ok = (near >= 0) & (near < len(own))
        ok[ok] = (group[near[ok]] == of[ok]) & (np.abs(at[near[ok]] - lines[ok]) <= SAME_EDGE)
        found[ok] = own[near[ok]]
    line, k = _spread((n_bands - 1)[of])
    k += (np.cumsum(n_bands) - n_bands)[of[line]]
    a, b = np.minimum(bands[k], bands[k + 1]), np.maximum(bands[k], bands[k + 1])
    drawn = np.zeros(len(line))
    has = np.flatnonzero(found[line] >= 0)
    edge, lo, hi = found[line[has]], a[has], b[has]
    begin, end = _among(edges.edge, edges.hi, edge, lo, "right"), _among(edges.edge, edges.lo, edge, hi, "left")
    side, span = _spread(np.maximum(end - begin, 0))
    span += begin[side]
    drawn[has] = np.bincount(side, _overlap(edges.lo[span], edges.hi[span], lo[side], hi[side]), len(has))
    drawn[found[line] < 0] = -1
    return drawn >= DRAWN_SHARE * (b - a)


def _cells(edges: _Edges, grids: _Grids) -> tuple[np.ndarray, ...]:
    """grid, r, c, above, below, before, behind of the cells of all grids, and the number of each grid's cells."""
    n_rows, n_columns = grids.n_rows - 1, grids.n_columns - 1
    counts = n_rows * n_columns
    grid, k = _spread(counts)
    r, c = k // np.maximum(n_columns[grid], 1), k % np.maximum(n_columns[grid], 1)
    level, upright = _sides(edges, grids, True), _sides(edges, grids, False)
    across, down = grids.n_rows * n_columns, grids.n_columns * n_rows
    above = (np.cumsum(across) - across)[grid] + r * n_columns[grid] + c
    before = (np.cumsum(down) - down)[grid] + c * n_rows[grid] + r
    return grid, r, c, level[above], level[above + n_columns[grid]], upright[before], upright[before + n_rows[grid]], counts


class _Text(NamedTuple):
    """Text cells by page, line and place in it. line: the number of their line among all; values: numbers of lines and cells."""

    page: np.ndarray
    line: np.ndarray
    x: np.ndarray
    ends: np.ndarray
    baseline: np.ndarray
    values: pa.StructArray


def _text(page: np.ndarray, cells: pa.StructArray) -> _Text:
    """A cell ends where the next one of its line begins, if it reaches that far."""
    line, cell, x, right, baseline = (cells.field(f).to_numpy(zero_copy_only=False) for f in ("line", "cell", "x", "right", "baseline"))
    order = np.lexsort((cell, line, page))
    page, line, x, right, baseline = (v[order] for v in (page, line, x, right, baseline))
    starts = _breaks(page, line)
    number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(page))))
    beyond = np.append(x[1:], np.nan)
    beyond[np.append(starts[1:], len(page))[: len(starts)] - 1] = np.nan
    return _Text(page, number, x, np.fmax(x, np.fmin(right, beyond)), baseline, cells.take(pa.array(order)))


def _places(text: _Text, grids: _Grids, page: np.ndarray) -> tuple[np.ndarray, ...]:
    """grid, text cell, r, place of the text cells within the height of a grid of their page: the row whose band holds the baseline, and
    the column; -1 for cells beside the grid, -2 for cells that lie across a column edge. page: that of each grid."""
    by_height = np.lexsort((text.baseline, text.page))
    by_height = by_height[~np.isnan(text.baseline[by_height])]
    heights, pages = text.baseline[by_height], text.page[by_height]
    row_ends, column_ends = np.cumsum(grids.n_rows), np.cumsum(grids.n_columns)
    top, bottom = grids.rows[row_ends - grids.n_rows], grids.rows[row_ends - 1]
    begin = _among(pages, heights, page, bottom - CELL_SLACK, "right")
    grid, own = _spread(np.maximum(_among(pages, heights, page, top + CELL_SLACK, "right") - begin, 0))
    own = by_height[own + begin[grid]]
    x, ends, baseline = text.x[own], text.ends[own], text.baseline[own]
    every = np.repeat(np.arange(len(page)), grids.n_rows)
    below = _among(every, grids.rows[np.lexsort((grids.rows, every))], grid, baseline, "left")
    reached = grids.n_rows[grid] - (below - (row_ends - grids.n_rows)[grid]) - (top[grid] >= baseline)
    r = np.minimum(reached, grids.n_rows[grid] - 2)
    every = np.repeat(np.arange(len(page)), grids.n_columns)
    first, last = column_ends - grids.n_columns, column_ends - 1
    rights, lefts = np.delete(np.arange(len(every)), first), np.delete(np.arange(len(every)), last)
    start = (first - np.arange(len(page)))[grid]
    k = _among(every[rights], grids.columns[rights] + CELL_SLACK, grid, ends, "left") - start
    fits = k < _among(every[lefts], grids.columns[lefts] - CELL_SLACK, grid, x, "right") - start
    beside = (ends <= grids.columns[first][grid] + CELL_SLACK) | (x >= grids.columns[last][grid] - CELL_SLACK)
    return grid, own, r, np.where(beside, -1, np.where(fits, k, -2))


class _Pages(NamedTuple):
    """Some pages: the numbers of their rules end to end, of which a drawing is named by the place of its first; grids, and the page of each."""

    numbers: pa.Array
    edges: _Edges
    grids: _Grids
    page: np.ndarray


def _pages(batch: pa.RecordBatch) -> _Pages:
    sizes = pc.list_value_length(batch.column("rules")).to_numpy(zero_copy_only=False)
    rules = batch.column("rules").flatten()
    number, x, y, width, height = (rules.field(f).to_numpy(zero_copy_only=False) for f in ("rule", "x", "y", "width", "height"))
    page = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((number, page))
    number, x, y, width, height = (v[order] for v in (number, x, y, width, height))
    new = np.zeros(len(page), np.int64)
    at = _breaks(page, number)  # rules of one number are of one drawing
    new[at] = at
    drawing = np.maximum.accumulate(new)[(np.cumsum(sizes) - sizes)[page] + _firsts(sizes, x, y, x + width, y + height)]
    edges = _edges(drawing, x, y, width, height)
    grids = _grids(edges)
    return _Pages(rules.field("rule").take(pa.array(order)), edges, grids, page[grids.drawing])


def _page_text(batch: pa.RecordBatch) -> _Text:
    sizes = pc.list_value_length(batch.column("text")).to_numpy(zero_copy_only=False)
    return _text(np.repeat(np.arange(len(sizes)), sizes), batch.column("text").flatten())


def _by_pages(pages: DataFrame, work: Callable[[pa.RecordBatch], tuple[np.ndarray, list]], key: list[str], schema: str) -> DataFrame:
    """Rows that `work` makes of some pages, with their key: the page of each row, and its other columns."""
    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in key)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [c for c in ("rules", "text") if c in batch.schema.names]
            held = np.cumsum(sum(pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in lists))
            # a page is always whole
            for part in np.split(np.arange(len(held)), np.flatnonzero(np.diff(held // MOST_ROWS)) + 1):
                some = batch.slice(part[0], len(part)) if len(part) else batch
                page, columns = work(some)
                keys = [some.column(k).take(pa.array(page)) for k in key]
                yield pa.RecordBatch.from_arrays([*keys, *columns], [*key, *names])

    return pages.mapInArrow(run, f"{kinds}, {schema}")


def _gathered(key: list[str], **parts: DataFrame) -> DataFrame:
    """A row for each page, with what each part has of it as an array of structs; pages that lack one are left out.

    The parts are one table when they are gathered, so a page is sorted and grouped once, and none of its arrays takes part in a join.
    """
    held = {name: F.struct(*[c for c in df.columns if c not in key]) for name, df in parts.items()}
    kinds = {name: df.select(held[name].alias("_")).schema[0].dataType for name, df in parts.items()}
    tall = None
    for own, df in parts.items():
        rows = df.select(*key, *[(held[own] if name == own else F.lit(None).cast(kind)).alias(name) for name, kind in kinds.items()])
        tall = rows if tall is None else tall.unionByName(rows)
    pages = tall.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).groupBy(*key)
    return pages.agg(*[F.collect_list(name).alias(name) for name in parts]).where(" AND ".join(f"size({name}) > 0" for name in parts))


def _rule_parts(rules: DataFrame, key: list[str]) -> DataFrame:
    return rules.select(*key, "rule", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")])


def _text_parts(text: DataFrame, key: list[str]) -> DataFrame:
    return text.select(*key, "line", "cell", *[F.col(c).cast("double").alias(c) for c in ("x", "right", "baseline")])


def grid_cells(rules: DataFrame, key: list[str]) -> DataFrame:
    """(key, drawing, r, c, above, below, before, behind): the cells of the grids that rules make, and whether their sides are drawn.

    rules: key, rule, x, y, width, height.
    """

    def work(batch: pa.RecordBatch) -> tuple[np.ndarray, list]:
        p = _pages(batch)
        grid, r, c, *sides, _ = _cells(p.edges, p.grids)
        drawing = p.numbers.take(pa.array(p.grids.drawing[grid]))
        return p.page[grid], [drawing, *[pa.array(v, pa.int32()) for v in (r, c)], *map(pa.array, sides)]

    kind = rules.schema["rule"].dataType.simpleString()
    schema = f"drawing {kind}, r int, c int, above boolean, below boolean, before boolean, behind boolean"
    return _by_pages(_gathered(key, rules=_rule_parts(rules, key)), work, key, schema)


def placements(rules: DataFrame, text: DataFrame, key: list[str]) -> DataFrame:
    """(key, drawing, line, cell, r, place): where the cells of text lines fall in the grids of their page.

    rules: key, rule, x, y, width, height. text: key, line, cell, x, right, baseline. r is the row whose band holds the baseline;
    place is a column, -1 for cells beside the grid, -2 for cells that lie across a column edge. A cell ends where the next one of
    its line begins, if it reaches that far. Edges give way by CELL_SLACK. Lines above and below a grid have no row there.
    """

    def work(batch: pa.RecordBatch) -> tuple[np.ndarray, list]:
        p, t = _pages(batch), _page_text(batch)
        grid, own, r, place = _places(t, p.grids, p.page)
        drawing = p.numbers.take(pa.array(p.grids.drawing[grid]))
        line, cell = (t.values.field(f).take(pa.array(own)) for f in ("line", "cell"))
        return p.page[grid], [drawing, line, cell, *[pa.array(v, pa.int32()) for v in (r, place)]]

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((rules, "rule"), (text, "line"), (text, "cell"))]
    schema = "drawing {}, line {}, cell {}, r int, place int".format(*kinds)
    return _by_pages(_gathered(key, rules=_rule_parts(rules, key), text=_text_parts(text, key)), work, key, schema)


def ruled_tables(rules: DataFrame, text: DataFrame, frames: DataFrame, key: list[str]) -> DataFrame:
    """One row per table cell: key, drawing, r, c, above, below, before, behind (whether its sides are drawn) and lines (numbers
    of the text lines with a part in it).

    rules: key, rule, x, y, width, height. text: key, line, cell, x, right, baseline. frames: key, left, right.
    A grid is a table unless it reaches out of its frame by more than FRAME_SLACK, holds no text, or has a line in its band
    with a cell across a column edge or with cells both inside and beside it.
    """

    def work(batch: pa.RecordBatch) -> tuple[np.ndarray, list]:
        p, t = _pages(batch), _page_text(batch)
        left, right = (batch.column(f).to_numpy(zero_copy_only=False)[p.page] for f in ("left", "right"))
        ends = np.cumsum(p.grids.n_columns)
        good = (p.grids.columns[ends - p.grids.n_columns] >= left - FRAME_SLACK) & (p.grids.columns[ends - 1] <= right + FRAME_SLACK)
        grid, own, r, place = _places(t, p.grids, p.page)
        line, most = t.line[own], len(t.page) + 1
        inside = place >= 0
        good &= np.bincount(grid[inside], minlength=len(good)) > 0
        good[grid[place == -2]] = False
        good[np.intersect1d((grid * most + line)[inside], (grid * most + line)[place == -1]) // most] = False
        of, row, column, *sides, counts = _cells(p.edges, p.grids)
        start = np.cumsum(counts) - counts
        cell = (start[grid] + r * (p.grids.n_columns - 1)[grid] + place)[inside]
        met, where = np.unique(cell * most + line[inside], return_index=True)
        numbers = t.values.field("line").take(pa.array(own[inside][where]))
        kept = good[of]
        mine = kept[met // most] if len(met) else np.zeros(0, bool)
        sizes = np.bincount(met // most, minlength=len(of))[kept]
        lines = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), numbers.filter(pa.array(mine)))
        drawing = p.numbers.take(pa.array(p.grids.drawing[of[kept]]))
        return p.page[of[kept]], [drawing, *[pa.array(v[kept], pa.int32()) for v in (row, column)], *[pa.array(v[kept]) for v in sides], lines]

    sides = [F.col(c).cast("double").alias(c) for c in ("left", "right")]
    pages = _gathered(key, rules=_rule_parts(rules, key), text=_text_parts(text, key), frames=frames.select(*key, *sides))
    pages = pages.select(*key, "rules", "text", F.inline("frames"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((rules, "rule"), (text, "line"))]
    schema = "drawing {}, r int, c int, above boolean, below boolean, before boolean, behind boolean, lines array<{}>".format(*kinds)
    return _by_pages(pages, work, key, schema)
