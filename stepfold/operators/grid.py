"""Spatial join of rectangles through a grid: rows are looked at together only where they share a cell.

A rectangle goes to the cells it touches, of a size that fits it: level 0 has cells of
``cell``, each further level of twice the side, and a rectangle's level is the least whose
cells are as large as it, so it touches four cells at most.  Two rectangles meet in the
cells of the higher of their levels; the one of them that holds the lower corner of their
intersection makes the pair, so each pair is made once and nothing is sorted out later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import box

#: Rectangles of over ``cell`` times two to this power touch more than four cells.
LEVELS = 12


def hull(*boxes: Column) -> Column:
    """The least rectangle around some, whose corners may be swapped."""
    ends = [[b[c] for b in boxes for c in pair] for pair in (("x1", "x2"), ("y1", "y2"))]
    return box(F.least(*ends[0]), F.least(*ends[1]), F.greatest(*ends[0]), F.greatest(*ends[1]))


def _cell(x: Column, level: Column, cell: float) -> Column:
    return F.floor(x / (F.lit(cell) * F.pow(F.lit(2.0), level))).cast("bigint")


def _corners(rows: DataFrame, keys: list[str], rectangle: str, cell: float, name: str) -> DataFrame:
    """The rows as structs ``name`` with keys, corners <name>_x1 ... and level; those that lack a corner are left out.

    The corners go through a generator, so that what they are made of is computed once.
    """
    r = F.col(rectangle)
    each = rows.select(F.struct(*rows.columns).alias(name), *keys, F.inline(F.array(F.struct(*(r[c].alias(f"{name}_{c}") for c in ("x1", "y1", "x2", "y2"))))))
    for c in ("x1", "y1", "x2", "y2"):
        v = F.col(f"{name}_{c}")
        each = each.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    side = F.greatest(F.col(f"{name}_x2") - F.col(f"{name}_x1"), F.col(f"{name}_y2") - F.col(f"{name}_y1"), F.lit(cell))
    return each.withColumn(f"{name}_level", F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(side / cell)))).cast("int"))


def placed(each: DataFrame, levels: list[int], cell: float, name: str) -> DataFrame:
    """Each row in the cells (level, cx, cy) it touches, at its level and all higher ones of ``levels``."""
    each = each.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda v: v >= F.col(f"{name}_level"))))
    for axis in ("x", "y"):
        low, high = (_cell(F.col(f"{name}_{axis}{k}"), F.col("level"), cell) for k in (1, 2))
        each = each.withColumn(f"c{axis}", F.explode(F.sequence(low, high)))
    return each


def meeting(left: DataFrame, right: DataFrame, keys: list[str], left_rectangle: str, right_rectangle: str, cell: float = 128.0) -> DataFrame:
    """(l, r): rows of equal ``keys`` whose rectangles (x1 <= x2, y1 <= y2) touch or overlap, each pair once.

    A row with a null key, a null or non-finite corner meets nothing.
    """
    a, b = _corners(left, keys, left_rectangle, cell, "l"), _corners(right, keys, right_rectangle, cell, "r")
    found = a.select(F.col("l_level").alias("v")).union(b.select(F.col("r_level").alias("v"))).distinct()
    levels = sorted(row["v"] for row in found.collect()) or [0]  # LEVELS + 1 at most
    both = placed(a, levels, cell, "l").join(placed(b, levels, cell, "r"), [*keys, "level", "cx", "cy"]).filter(F.col("level") == F.greatest("l_level", "r_level"))
    touch = F.expr("l_x1 <= r_x2 AND r_x1 <= l_x2 AND l_y1 <= r_y2 AND r_y1 <= l_y2")
    owner = [F.col(f"c{axis}") == _cell(F.greatest(f"l_{axis}1", f"r_{axis}1"), F.col("level"), cell) for axis in ("x", "y")]
    return both.filter(touch & owner[0] & owner[1]).select("l", "r")
