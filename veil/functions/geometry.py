"""Box arithmetic on structs of x, y, width, height."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def box(x, y, width, height) -> Column:
    cols = [c if isinstance(c, Column) else F.col(c) for c in (x, y, width, height)]
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(cols, ("x", "y", "width", "height"))])


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def overlap_x(a: Column, b: Column) -> Column:
    return F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])


def overlap_y(a: Column, b: Column) -> Column:
    return F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])


def intersection(a: Column, b: Column) -> Column:
    w, h = overlap_x(a, b), overlap_y(a, b)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 when the union is empty."""
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(0.0)


def coverage(inner: Column, outer: Column) -> Column:
    """Share of the inner box that lies in the outer one."""
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def union_box(boxes: Column) -> Column:
    """Smallest box around an array of boxes, null for none."""
    x, y = F.array_min(F.transform(boxes, lambda b: b["x"])), F.array_min(F.transform(boxes, lambda b: b["y"]))
    r, d = F.array_max(F.transform(boxes, right)), F.array_max(F.transform(boxes, bottom))
    return F.when(F.size(boxes) > 0, box(x, y, r - x, d - y))


def pad(b: Column, by: float) -> Column:
    return box(F.greatest(b["x"] - by, F.lit(0.0)), F.greatest(b["y"] - by, F.lit(0.0)), b["width"] + 2 * by, b["height"] + 2 * by)
