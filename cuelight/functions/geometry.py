"""Boxes as column expressions: x and y of the upper left corner, width and height."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column


def box(prefix: str = "") -> Box:
    return Box(*[F.col(f"{prefix}{c}") for c in "xywh"])


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.w) * F.greatest(F.lit(0.0), b.h)


def iou(a: Box, b: Box) -> Column:
    """Intersection by union; 0 for empty boxes."""
    zero = F.lit(0.0)
    shared = F.greatest(zero, F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)) * F.greatest(
        zero, F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    )
    union = area(a) + area(b) - shared
    return F.when(union == 0, zero).otherwise(F.try_divide(shared, union))


def centre_ratio(a: Box, b: Box, width: Column, height: Column) -> Column:
    """The distance of centres by the frame's diagonal."""
    diagonal = F.hypot(F.greatest(width, F.lit(1)).cast("double"), F.greatest(height, F.lit(1)).cast("double"))
    return F.hypot((a.x + a.w / 2) - (b.x + b.w / 2), (a.y + a.h / 2) - (b.y + b.h / 2)) / diagonal


def position(b: Box, width: Column, height: Column) -> Column:
    """Where in the frame a box lies, in thirds."""
    cx, cy = (b.x + b.w / 2) / width, (b.y + b.h / 2) / height
    third = F.lit(1.0) / 3
    across = F.when(cx < third, "Left").when(cx > 2 * third, "Right").otherwise("Center")
    down = F.when(cy < third, "Upper").when(cy > 2 * third, "Lower").otherwise("Center")
    return (
        F.when((width <= 0) | (height <= 0), "Unknown")
        .when((b.w / width > 0.65) | (b.h / height > 0.45), "Multiple / Large Area")
        .when((across == "Center") & (down == "Center"), "Center")
        .otherwise(F.concat(down, F.lit(" "), across))
    )


def union_box() -> list[Column]:
    """Aggregates x, y, w, h of the hull of many boxes."""
    low_x, low_y = F.min("x"), F.min("y")
    return [
        low_x.alias("x"),
        low_y.alias("y"),
        (F.max(F.col("x") + F.col("w")) - low_x).alias("w"),
        (F.max(F.col("y") + F.col("h")) - low_y).alias("h"),
    ]


def polygon_box(polygon: Column) -> Column:
    """The hull of a polygon; zeros for an empty one."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    low_x, low_y = F.array_min(xs), F.array_min(ys)
    none = F.lit(0.0)
    return F.struct(
        F.coalesce(low_x, none).alias("x"),
        F.coalesce(low_y, none).alias("y"),
        F.coalesce(F.array_max(xs) - low_x, none).alias("w"),
        F.coalesce(F.array_max(ys) - low_y, none).alias("h"),
    )


def box_polygon(b: Box) -> Column:
    """The corners, clockwise from the upper left one."""
    right, low = b.x + b.w, b.y + b.h
    return F.array(F.array(b.x, b.y), F.array(right, b.y), F.array(right, low), F.array(b.x, low))


def box_of_numbers(numbers: Column) -> Column:
    """Four numbers as a box: corners if the second pair isn't smaller, else x, y, width, height."""
    x, y, c, d = (numbers[i] for i in range(4))
    corners = (c >= x) & (d >= y)
    return F.struct(
        x.alias("x"), y.alias("y"), F.when(corners, c - x).otherwise(c).alias("w"), F.when(corners, d - y).otherwise(d).alias("h")
    )
