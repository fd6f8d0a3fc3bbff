"""Box geometry as Column functions; a box is a struct of x1, y1, x2, y2 (double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    names = ("x1", "y1", "x2", "y2")
    return F.struct(*(v.alias(n) for n, v in zip(names, (x1, y1, x2, y2), strict=True)))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def safe_box(b: Column, height: float, width: float) -> Column:
    """Corners rounded half to even and clamped to the image; null where nothing is left."""
    x1, x2 = (F.greatest(F.lit(0.0), F.least(F.lit(width - 1.0), F.bround(b[c], 0))) for c in ("x1", "x2"))
    y1, y2 = (F.greatest(F.lit(0.0), F.least(F.lit(height - 1.0), F.bround(b[c], 0))) for c in ("y1", "y2"))
    return F.when((x2 > x1) & (y2 > y1), box(x1, y1, x2, y2))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Exact intersection over union; 0 where both are empty."""
    union = area(a) + area(b) - overlap(a, b)
    return F.when(union > 0, overlap(a, b) / union).otherwise(0.0)


def iou_eps(a: Column, b: Column) -> Column:
    """Intersection over union with 1e-6 added to the denominator, as the greedy matcher wants it."""
    return overlap(a, b) / (area(a) + area(b) - overlap(a, b) + 1e-6)


def cover(a: Column, b: Column) -> Column:
    """Share of ``a`` that ``b`` covers."""
    return overlap(a, b) / F.greatest(area(a), F.lit(1e-6))


def center_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) * 0.5


def center_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) * 0.5


def center_distance(a: Column, b: Column, height: float, width: float) -> Column:
    """Distance of the centres over the image's diagonal."""
    dx, dy = center_x(a) - center_x(b), center_y(a) - center_y(b)
    return F.sqrt(dx * dx + dy * dy) / float((height**2 + width**2) ** 0.5)


def center_inside(a: Column, b: Column) -> Column:
    """Whether the centre of ``a`` lies in ``b``."""
    return center_x(a).between(b["x1"], b["x2"]) & center_y(a).between(b["y1"], b["y2"])


def expanded(g: Column, ratio: float, margin: float) -> Column:
    """``g`` widened on each side by a ratio of that side's length, by ``margin`` at least."""
    mx = F.greatest(F.lit(margin), F.greatest(F.lit(1.0), g["x2"] - g["x1"]) * ratio)
    my = F.greatest(F.lit(margin), F.greatest(F.lit(1.0), g["y2"] - g["y1"]) * ratio)
    return box(g["x1"] - mx, g["y1"] - my, g["x2"] + mx, g["y2"] + my)


def expanded_contains(g: Column, a: Column, ratio: float, margin: float) -> Column:
    """Whether the centre of ``a`` lies in ``g`` widened by a ratio of its sides, by ``margin`` at least."""
    wide = expanded(g, ratio, margin)
    return center_x(a).between(wide["x1"], wide["x2"]) & center_y(a).between(wide["y1"], wide["y2"])


def to_center_size(b: Column, height: float, width: float) -> Column:
    """Normalised centre and size, each clipped to [0, 1]."""
    return F.struct(
        clip01(center_x(b) / width).alias("cx"),
        clip01(center_y(b) / height).alias("cy"),
        clip01((b["x2"] - b["x1"]) / width).alias("w"),
        clip01((b["y2"] - b["y1"]) / height).alias("h"),
    )


def padded(b: Column, pad: float, height: float, width: float) -> Column:
    """Crop rectangle of a box with a share of its sides added on each side, inside the image."""
    px, py = (b["x2"] - b["x1"]) * pad, (b["y2"] - b["y1"]) * pad
    return box(F.greatest(F.lit(0.0), b["x1"] - px), F.greatest(F.lit(0.0), b["y1"] - py), F.least(F.lit(float(width)), b["x2"] + px), F.least(F.lit(float(height)), b["y2"] + py))
