"""Expressions over boxes: structs of x, y, width, height in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,width:double,height:double>"


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(*[v.cast("double").alias(n) for v, n in ((x, "x"), (y, "y"), (width, "width"), (height, "height"))])


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return box(x0, y0, x1 - x0, y1 - y0)


def union(a: Column, b: Column) -> Column:
    return corners(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(right(a), right(b)), F.greatest(bottom(a), bottom(b)))


def union_all(boxes: Column) -> Column:
    """Of an array of boxes; null if it is empty."""
    least = lambda f: F.array_min(F.transform(boxes, f))
    most = lambda f: F.array_max(F.transform(boxes, f))
    return F.when(F.size(boxes) > 0, corners(least(lambda b: b["x"]), least(lambda b: b["y"]), most(right), most(bottom)))


def union_agg(b: Column) -> Column:
    """The union as an aggregate function."""
    return corners(F.min(b["x"]), F.min(b["y"]), F.max(right(b)), F.max(bottom(b)))


def centre_inside(inner: Column, outer: Column) -> Column:
    cx, cy = inner["x"] + inner["width"] / 2, inner["y"] + inner["height"] / 2
    return (cx >= outer["x"]) & (cx <= right(outer)) & (cy >= outer["y"]) & (cy <= bottom(outer))


def overlap(a: Column, b: Column) -> Column:
    width = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    height = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return F.when((width > 0) & (height > 0), width * height).otherwise(0.0)


def overlap_ratio(inner: Column, outer: Column) -> Column:
    area = inner["width"] * inner["height"]
    return F.when(area > 0, overlap(inner, outer) / area).otherwise(0.0)


def contains(outer: Column, inner: Column, slack: float = 1.0) -> Column:
    return (
        (inner["x"] >= outer["x"] - slack)
        & (inner["y"] >= outer["y"] - slack)
        & (right(inner) <= right(outer) + slack)
        & (bottom(inner) <= bottom(outer) + slack)
    )


def iou(a: Column, b: Column) -> Column:
    common = overlap(a, b)
    return F.when(common > 0, common / (a["width"] * a["height"] + b["width"] * b["height"] - common)).otherwise(0.0)


def same_region(a: Column, b: Column) -> Column:
    """Boxes that stand for one region: one inside the other, or more than half in common."""
    return contains(a, b) | contains(b, a) | (iou(a, b) > 0.5)


def padded(b: Column, by: float, width: Column, height: Column) -> Column:
    """Grown on all sides and clipped to the page; an unknown page size does not clip."""
    x1, y1 = right(b) + by, bottom(b) + by
    return corners(F.greatest(F.lit(0.0), b["x"] - by), F.greatest(F.lit(0.0), b["y"] - by), F.least(x1, F.coalesce(width, x1)), F.least(y1, F.coalesce(height, y1)))


def clipped(b: Column, width: Column, height: Column) -> Column:
    x, y = F.greatest(F.lit(0.0), b["x"]), F.greatest(F.lit(0.0), b["y"])
    return box(x, y, F.least(b["width"], width - x), F.least(b["height"], height - y))


def pixels(b: Column) -> Column:
    """Whole pixels that the box touches."""
    x, y = F.floor(b["x"]), F.floor(b["y"])
    return box(x, y, F.ceil(right(b)) - x, F.ceil(bottom(b)) - y)
