"""Boxes, transforms and distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def half_up(x: Column) -> Column:
    """Halves go towards plus infinity."""
    return F.floor(x + 0.5)


def affine(m: Column, x: Column, y: Column) -> Column:
    """Point (x, y) under [a, b, c, d, e, f]."""
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def affine_product(m: Column, n: Column) -> Column:
    """The transform that applies n first, then m."""
    return F.array(m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5])


def scaled_rect(box: Column, scale: Column) -> Column:
    """Box [x1, y1, x2, y2], corners in any order, as left, top, width and height at a scale."""
    return F.struct((F.least(box[0], box[2]) * scale).alias("left"), (F.least(box[1], box[3]) * scale).alias("top"), (F.abs(box[2] - box[0]) * scale).alias("width"), (F.abs(box[3] - box[1]) * scale).alias("height"))


def length(dx: Column, dy: Column) -> Column:
    """Of a vector. The root of the sum of squares, as SQL has it: hypot differs from it in the last place, which decides for points just at a radius. pow by 2 is
    the plain product and, unlike it, takes dx and dy once."""
    return F.sqrt(F.pow(dx, F.lit(2.0)) + F.pow(dy, F.lit(2.0)))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment, which may be a point."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(clamp(((px - ax) * dx + (py - ay) * dy) / F.nullif(square, F.lit(0.0)), 0.0, 1.0))
    return length(px - (ax + t * dx), py - (ay + t * dy))


def number_setting(text: Column, low: float, high: float, default: float) -> Column:
    """A finite number within bounds, else the default."""
    x = text.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(clamp(x, low, high))
