"""Step scores as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import clip01


def finite(x: Column) -> Column:
    """Whether a number is there and neither NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def present(x: Column) -> Column:
    """Null in place of NaN, so that aggregates skip it."""
    return F.when(~F.isnan(x), x)


def action_score(sign_correct: Column, expected: Column, abs_err: Column, unit: Column) -> Column:
    """Direction times one half and half the magnitude's quality; a wrong direction scores 0 whatever the rest holds."""
    floor = F.when(unit.startswith("m"), 0.1).otherwise(5.0)
    quality = 1 / (1 + abs_err / F.greatest(F.abs(expected), floor))
    return F.when(sign_correct == 0, 0.0).otherwise(sign_correct * (1 + quality) / 2)


def f1(g: Column, p: Column, m: Column) -> Column:
    return F.when(g + p > 0, 2.0 * m / (g + p)).otherwise(0.0)


def object_components(g: Column, p: Column, m: Column, center_err: Column, integrity: Column, relative: Column) -> dict[str, Column]:
    """Recall, F1, spatial, integrity and the step's score; quality columns are not looked at without a match."""
    recall = m / g
    position = F.when(m > 0, recall * clip01(1 - center_err)).otherwise(0.0)
    whole = F.when(m > 0, recall * clip01(integrity)).otherwise(0.0)
    spatial = F.when(g >= 2, (position + clip01(relative)) / 2).otherwise(position)
    f = f1(g, p, m)
    return {"recall": recall, "f1": f, "spatial": spatial, "integrity": whole, "ssp_step": (f + spatial + whole) / 3}


def mean_plus_worst(x: str) -> Column:
    """Aggregate: the mean of the mean and the least."""
    return (F.avg(x) + F.min(x)) / 2


def available_composite(values: list[Column], weights: list[float]) -> Column:
    """Weighted mean over the values that are there; null where none is."""
    top = sum((F.when(v.isNotNull(), v * w).otherwise(0.0) for v, w in zip(values, weights, strict=True)), F.lit(0.0))
    den = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in zip(values, weights, strict=True)), F.lit(0.0))
    return F.when(den > 0, top / den)


def signed_gap(a: Column, b: Column) -> Column:
    """Relative signed depth: the difference over the mean magnitude."""
    return (a - b) / F.greatest((F.abs(a) + F.abs(b)) / 2, F.lit(1e-8))
