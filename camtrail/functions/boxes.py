"""Box and polygon expressions. A box is a Column struct, or a mapping, with x1, y1, x2, y2."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def iou(a, b) -> Column:
    """Intersection over union, 0 when the boxes do not overlap."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    area = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    union = area - inter
    return F.when((inter <= 0) | (union <= 0), F.lit(0.0)).otherwise(F.try_divide(inter, union))


def clamp(x1, y1, x2, y2, width, height) -> dict[str, Column]:
    """Box cut to the frame; test ``has_area`` before use."""
    return {
        "x1": F.greatest(F.lit(0), x1),
        "y1": F.greatest(F.lit(0), y1),
        "x2": F.least(width, x2),
        "y2": F.least(height, y2),
    }


def has_area(box) -> Column:
    return (box["x2"] > box["x1"]) & (box["y2"] > box["y1"])


def at_least(box, side: float) -> Column:
    """Both sides at least ``side`` pixels."""
    return ((box["x2"] - box["x1"]) >= side) & ((box["y2"] - box["y1"]) >= side)


def normalise(box, width, height) -> dict[str, Column]:
    """Pixel box to fractions of the frame, 4 decimals."""
    return {
        "x1": F.round(box["x1"] / width, 4),
        "y1": F.round(box["y1"] / height, 4),
        "x2": F.round(box["x2"] / width, 4),
        "y2": F.round(box["y2"] / height, 4),
    }


def crop_quality(conf, box_w, box_h, frame_w, frame_h, sharpness) -> Column:
    """Confidence x relative size x clipped sharpness (Laplacian variance as a column)."""
    area = F.greatest(F.lit(1.0), box_w) * F.greatest(F.lit(1.0), box_h)
    size = F.sqrt(area / F.greatest(F.lit(1.0), frame_w * frame_h))
    sharp = F.least(F.greatest(F.coalesce(sharpness, F.lit(0.0)) / 120.0, F.lit(0.05)), F.lit(5.0))
    return conf * size * sharp


def _crosses(x, y, x1, y1, x2, y2) -> Column:
    at = F.try_divide((y - y1) * (x2 - x1), y2 - y1) + x1
    return (
        (y > F.least(y1, y2))
        & (y <= F.greatest(y1, y2))
        & (x <= F.greatest(x1, x2))
        & ((x1 == x2) | F.coalesce(x <= at, F.lit(False)))
    )


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd test against an ARRAY<STRUCT<x,y>>; fewer than 3 corners accept everything."""
    rotated = F.concat(F.slice(polygon, 2, F.size(polygon) - 1), F.slice(polygon, 1, 1))
    edges = F.zip_with(
        polygon, rotated, lambda p, q: _crosses(x, y, p["x"], p["y"], q["x"], q["y"]).cast("int")
    )
    crossings = F.aggregate(edges, F.lit(0), lambda s, e: s + e)
    return F.when(polygon.isNull() | (F.size(polygon) < 3), F.lit(True)).otherwise(crossings % 2 == 1)


def in_fixed_polygon(x: Column, y: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """As ``in_polygon`` for a polygon known when the plan is made: a flat, code-generated sum."""
    if len(corners) < 3:
        return F.lit(True)
    total = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]]):
        total = total + _crosses(x, y, *[F.lit(float(v)) for v in (x1, y1, x2, y2)]).cast("int")
    return total % 2 == 1
