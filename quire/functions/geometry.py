"""Bounding boxes as structs of x0, y0, x1, y1 in points, origin at the bottom left."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")
A4_HEIGHT = 842.0


def bbox(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[v.cast("double").alias(n) for n, v in zip(SIDES, (x0, y0, x1, y1), strict=True)])


def is_valid(box: Column) -> Column:
    return F.coalesce((box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), F.lit(False))


def union(a: Column, b: Column) -> Column:
    return bbox(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def union_all(box: Column, window: WindowSpec | None = None) -> Column:
    """The aggregate that spans all boxes of a group or window."""
    sides = [F.min(box["x0"]), F.min(box["y0"]), F.max(box["x1"]), F.max(box["y1"])]
    return bbox(*[s.over(window) if window else s for s in sides])


def flipped(x0: Column, top: Column, x1: Column, bottom: Column, height: Column) -> Column:
    """From coordinates that grow downwards from the page's top."""
    return bbox(x0, height - bottom, x1, height - top)


def from_top_left(left: Column, top: Column, right: Column, bottom: Column, height: Column | None = None) -> Column:
    """As flipped(), for boxes of which sides may be swapped or equal: equal sides are moved 1 point apart."""
    tall = F.lit(A4_HEIGHT) if height is None else height
    low, high = F.least(tall - bottom, tall - top), F.greatest(tall - bottom, tall - top)
    x0, x1 = F.least(left, right), F.greatest(left, right)
    apart = lambda a, b: F.when(b <= a, a + 1.0).otherwise(b)
    return bbox(x0, low, apart(x0, x1), apart(low, high))


def column_bucket(x0: Column, width: Column) -> Column:
    """Which fifth of the page's width a character starts in."""
    return F.greatest(F.lit(0), F.least(F.lit(4), (x0 / width * 5).cast("int")))
