"""Depth and size measures as Column functions: medians in a box's middle, crops of an aspect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a valid depth, the margin left out on each side of a box, the pixels needed.
NEAREST, FARTHEST, MARGIN, PIXELS = 0.05, 20.0, 0.10, 16


def median_valid(values: Column, least: int = 1) -> Column:
    """Median of the valid depths of an array; null for fewer than ``least``."""
    good = F.array_sort(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (v > NEAREST) & (v < FARTHEST)))

    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n >= max(least, 1), (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)

    return F.get(F.transform(F.array(good), middle), F.lit(0))


def inner_median(values: Column, height: int, width: int, box: Column, image: tuple[float, float] | None = None, least: int = PIXELS, margin: float = MARGIN) -> Column:
    """Median valid depth in the middle of a box over a row-wise ``height`` x ``width`` grid.

    ``image`` is the (height, width) that the box's corners refer to; without it they
    are the grid's.  Corners may be swapped; a box under one pixel has no depth.
    """

    def side(a: Column, b: Column, size: int, whole: float | None) -> tuple[Column, Column, Column]:
        low, high = F.least(a, b), F.greatest(a, b)
        length = high - low
        cut = F.least(length * margin, F.greatest(F.lit(0.0), (length - 1.0) * 0.45))
        scale = size / float(whole or size)
        first = F.greatest(F.lit(0), F.least(F.lit(size), F.floor((low + cut) * scale)))
        end = F.greatest(F.lit(0), F.least(F.lit(size), F.ceil((high - cut) * scale)))
        return first.cast("int"), end.cast("int"), length >= 1.0

    x1, x2, wide = side(box["x1"], box["x2"], width, image and image[1])
    y1, y2, high = side(box["y1"], box["y2"], height, image and image[0])
    inside = F.flatten(F.transform(F.sequence(y1, y2 - 1), lambda y: F.slice(values, y * width + x1 + 1, x2 - x1)))
    finite = F.forall(F.array(box["x1"], box["x2"], box["y1"], box["y2"]), lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(finite & wide & high & (x2 > x1) & (y2 > y1), median_valid(inside, least))


def masked_median(values: Column, mask: Column) -> Column:
    """Median valid depth where a mask (array of booleans, as long) holds; null for another length."""
    return F.when(F.size(values) == F.size(mask), median_valid(F.zip_with(values, mask, lambda v, m: F.when(m, v))))


def centre_crop(width: Column, height: Column, aspect: Column) -> Column:
    """The largest centred box of an aspect in an image (x1, y1, x2, y2, applied)."""
    own = width / height
    same = F.abs(own - aspect) <= 1e-8
    w = F.when(same | (own <= aspect), width).otherwise(F.greatest(F.lit(1), F.least(width, F.bround(height * aspect, 0).cast("int"))))
    h = F.when(same | (own > aspect), height).otherwise(F.greatest(F.lit(1), F.least(height, F.bround(width / aspect, 0).cast("int"))))
    x, y = F.floor((width - w) / 2).cast("int"), F.floor((height - h) / 2).cast("int")
    return F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"), (~same).alias("applied"))


def stretch_side(width: Column, height: Column) -> Column:
    """The side of the square an image is stretched to."""
    return F.greatest(F.lit(1), F.least(width, height))


def rotation_error(component: Column, yaw: tuple[Column, Column], pitch: tuple[Column, Column], other: tuple[Column, Column]) -> Column:
    """|predicted - expected| of the component that an action is about; null where either is not finite."""

    def error(pair: tuple[Column, Column]) -> Column:
        a, b = (F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x) for x in pair)
        return F.abs(a - b)

    return F.when(component == "yaw_deg", error(yaw)).when(component == "pitch_deg", error(pitch)).otherwise(error(other))
