"""Camera conventions: intrinsics, axis changes, digests."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled_intrinsics(k: Column, stages: Column) -> Column:
    """A 3x3 matrix (array of arrays) after resize stages: focal lengths and centre times their product."""
    factor = F.aggregate(stages, F.lit(1.0), lambda a, s: a * s)
    return F.transform(k, lambda row, i: F.when(i < 2, F.transform(row, lambda v: v * factor)).otherwise(row))


def fov_intrinsics(fov: Column, width: Column, height: Column, pixel_centres: bool = False) -> Column:
    """Pinhole intrinsics of a horizontal field of view in radians, square pixels, centred.

    With ``pixel_centres`` the centre is that of a grid whose first pixel lies at 0.
    """
    f = width / 2 / F.tan(fov / 2)
    zero, one, less = F.lit(0.0), F.lit(1.0), 1 if pixel_centres else 0
    return F.array(F.array(f, zero, (width - less) / 2), F.array(zero, f, (height - less) / 2), F.array(zero, zero, one))


def flip_axes(pose: Column, signs: tuple[int, int, int] = (1, -1, -1)) -> Column:
    """A camera-to-world matrix whose camera axes are turned by signs (y and z: graphics to vision)."""
    return F.transform(pose, lambda row: F.transform(row, lambda v, j: F.when(j == 1, v * signs[1]).when(j == 2, v * signs[2]).when(j == 0, v * signs[0]).otherwise(v)))


def swap_world(pose: Column) -> Column:
    """World axes x, y, z to y, x, -z (rows permuted)."""
    return F.array(pose[1], pose[0], F.transform(pose[2], lambda v: -v), pose[3])


def digest(values: list[float]) -> str:
    """SHA-256 of little-endian doubles; a negative zero counts as zero."""
    return hashlib.sha256(struct.pack(f"<{len(values)}d", *(v + 0.0 for v in values))).hexdigest()


def with_digest(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the digest of an array of doubles."""

    @F.pandas_udf("string")
    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda v: None if v is None else digest(np.asarray(v, float).tolist()))

    return df.withColumn(name, run(F.col(column)))
