"""Rectangles, rotations and transforms as column expressions. Points have y up; rectangles are x, y, width, height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_share(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Share of the first rectangle's area that lies in the second."""
    area = overlap_length(ax, ax + aw, bx, bx + bw) * overlap_length(ay, ay + ah, by, by + bh)
    return area / (aw * ah)


def gap(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Distance between two rectangles, 0 when they touch."""
    dx = F.greatest(F.lit(0.0), bx - (ax + aw), ax - (bx + bw))
    dy = F.greatest(F.lit(0.0), by - (ay + ah), ay - (by + bh))
    return F.hypot(dx, dy)


def contains(px: Column, py: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    return (px >= x) & (px <= x + w) & (py >= y) & (py <= y + h)


def to_display(x: Column, y: Column, width: Column, height: Column, rotation: Column) -> Column:
    """struct(x, y) of a user-space point on the page as it is shown, turned clockwise, origin at the lower left."""
    return (
        F.when(rotation == 90, F.struct(y.alias("x"), (width - x).alias("y")))
        .when(rotation == 180, F.struct((width - x).alias("x"), (height - y).alias("y")))
        .when(rotation == 270, F.struct((height - y).alias("x"), x.alias("y")))
        .otherwise(F.struct(x.alias("x"), y.alias("y")))
    )


def to_user(x: Column, y: Column, width: Column, height: Column, rotation: Column) -> Column:
    """The inverse of to_display; width and height are the unturned page's."""
    return (
        F.when(rotation == 90, F.struct((width - y).alias("x"), x.alias("y")))
        .when(rotation == 180, F.struct((width - x).alias("x"), (height - y).alias("y")))
        .when(rotation == 270, F.struct(y.alias("x"), (height - x).alias("y")))
        .otherwise(F.struct(x.alias("x"), y.alias("y")))
    )


def apply_matrix(m: list[Column], x: Column, y: Column) -> Column:
    """struct(x, y) under the affine matrix [a b c d e f]."""
    a, b, c, d, e, f = m
    return F.struct((a * x + c * y + e).alias("x"), (b * x + d * y + f).alias("y"))


def multiply(m: list[Column], n: list[Column]) -> list[Column]:
    """The matrix that applies n first, then m."""
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return [a * g + c * h, b * g + d * h, a * i + c * j, b * i + d * j, a * k + c * o + e, b * k + d * o + f]


def shift_inside(x: Column, w: Column, page: Column) -> Column:
    """Position moved by as little as needed to lie on the page; a thing that is too wide starts at 0."""
    return F.greatest(F.lit(0.0), F.least(x, page - w))


def corner(position: str, w: Column, h: Column, width: Column, height: Column, margin: float) -> Column:
    """struct(x, y) of a box in a corner, or at the bottom centre."""
    m = F.lit(margin)
    left, right, low, high = m, width - w - m, m, height - h - m
    places = {
        "top-left": (left, high), "top-right": (right, high), "bottom-left": (left, low), "bottom-right": (right, low),
        "bottom-center": ((width - w) / 2, low),
    }
    x, y = places[position]
    return F.struct(x.alias("x"), y.alias("y"))


def range_box(x: Column, width: Column, n_chars: Column, start: Column, end: Column) -> Column:
    """struct(x, width) of the characters start..end of a run, advancing evenly."""
    step = width / n_chars
    return F.struct((x + step * start).alias("x"), (step * (end - start)).alias("width"))
