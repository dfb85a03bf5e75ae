"""Boxes, polygons, tiles and rotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arithmetic import div

SIDES = ["x0", "y0", "x1", "y1"]


def area(b) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def intersection(a, b) -> Column:
    width = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    height = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))


def meets(a, b) -> Column:
    """Boxes share some area; cheap, so it is tested before the ratios."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def iou(a, b) -> Column:
    inter = intersection(a, b)
    return inter / F.greatest(F.lit(1), area(a) + area(b) - inter)


def over_smaller(a, b) -> Column:
    """Intersection over the smaller area."""
    return intersection(a, b) / F.greatest(F.lit(1), F.least(area(a), area(b)))


def same_text_region(a, b) -> Column:
    """Same place, or contained text at nearly the same place.

    ``a`` and ``b`` offer x0, y0, x1, y1 and key (the agreement text).
    """
    contained = F.contains(a["key"], b["key"]) | F.contains(b["key"], a["key"])
    named = (a["key"] != "") & (b["key"] != "")
    return meets(a, b) & ((iou(a, b) >= 0.55) | (named & contained & (over_smaller(a, b) >= 0.85)))


def named(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in [*SIDES, "key"]}


def polygon_box(points: Column, width: Column, height: Column) -> Column:
    """Clipped integer box of a polygon given as array<array<double>>."""
    xs = F.transform(points, lambda p: p[0])
    ys = F.transform(points, lambda p: p[1])
    return F.struct(
        F.greatest(F.lit(0), F.floor(F.array_min(xs))).alias("x0"),
        F.greatest(F.lit(0), F.floor(F.array_min(ys))).alias("y0"),
        F.least(width, F.ceil(F.array_max(xs))).alias("x1"),
        F.least(height, F.ceil(F.array_max(ys))).alias("y1"),
    )


def reading_geometry(points: Column) -> Column:
    """Centre and size of a reading; a missing polygon gives a unit box at 0."""
    xs = F.transform(points, lambda p: p[0])
    ys = F.transform(points, lambda p: p[1])
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.struct(
        F.coalesce((x0 + x1) / 2, F.lit(0.0)).alias("cx"),
        F.coalesce((y0 + y1) / 2, F.lit(0.0)).alias("cy"),
        F.greatest(F.lit(1.0), F.coalesce(x1 - x0, F.lit(1.0))).alias("width"),
        F.greatest(F.lit(1.0), F.coalesce(y1 - y0, F.lit(1.0))).alias("height"),
    )


def unrotate(points: Column, angle: Column, width, height, dx, dy) -> Column:
    """Points of a clockwise-rotated tile back in image coordinates."""

    def one(p: Column) -> Column:
        x, y = p[0], p[1]
        ox = F.when(angle == 90, y).when(angle == 180, width - x).when(angle == 270, width - y).otherwise(x)
        oy = F.when(angle == 90, height - x).when(angle == 180, height - y).when(angle == 270, x).otherwise(y)
        return F.array(F.round(ox + dx, 3), F.round(oy + dy, 3))

    return F.transform(points, one)


def tile_origins(length: Column, tile: int, overlap: int) -> Column:
    """Tile starts along an axis; the last tile is flush with the edge."""
    last = length - tile
    return F.when(length <= tile, F.array(F.lit(0).cast("long"))).otherwise(
        F.array_union(
            F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(tile - overlap).cast("long")),
            F.array(last.cast("long")),
        )
    )


def valid_box(b, width: Column, height: Column) -> Column:
    return (
        (b["x0"] >= 0) & (b["y0"] >= 0) & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])
        & (b["x1"] <= width) & (b["y1"] <= height)
    )


def cell_range(low: Column, high: Column, cell: int) -> Column:
    """Grid cells touched by [low, high)."""
    return F.sequence(div(low, cell), div(F.greatest(high - 1, low), cell))
