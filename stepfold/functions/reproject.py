"""Masks carried from one view to another, what a view can show, and edges (numpy kernels for mapInPandas)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .images import closed, dilate, resized

#: Usable depths, points at least, points at most, scales tried for both intrinsics, and the visible share.
NEAR, FAR, LEAST, MOST, SCALES, VISIBLE = 0.05, 20.0, 10, 20_000, (1.0, 2.0, 0.5), 0.25
#: Canny's thresholds.
LOW, HIGH = 60, 150


def usable(depth: np.ndarray) -> np.ndarray:
    return np.isfinite(depth) & (depth > NEAR) & (depth < FAR)


def _scaled(k: np.ndarray, s: float) -> np.ndarray:
    return k * np.array([[s, 1, s], [1, s, s], [1, 1, 1]], k.dtype)


def carry(mask: np.ndarray, depth: np.ndarray, pose: np.ndarray, k: np.ndarray, to_pose: np.ndarray, to_k: np.ndarray, size: tuple[int, int]) -> np.ndarray | None:
    """Where a mask's pixels fall in another view, as a mask of ``size``; None if too few do.

    It isn't known whether intrinsics belong to this image size and whether poses
    map to the world or from it, so every scale is tried with both directions and
    the first with the most pixels inside wins.  Only which pixels are hit matters,
    so nearer points need not be drawn last.  Gaps are closed.
    """
    depth = np.asarray(depth, np.float32)
    if min(size) <= 0 or pose.shape != (4, 4) or to_pose.shape != (4, 4):
        return None
    mask = resized(np.asarray(mask), depth.shape) if mask.shape != depth.shape else mask
    y, x = np.nonzero(mask)
    if len(x) < LEAST:
        return None
    good = usable(depth[y, x])
    y, x = y[good], x[good]
    if len(x) > MOST:
        pick = np.linspace(0, len(x) - 1, MOST).astype(np.int64)
        y, x = y[pick], x[pick]
    pixels, z = np.stack((x, y, np.ones_like(x))).astype(float), depth[y, x].astype(float)
    best = np.empty((2, 0), np.int64)
    for s in SCALES:
        try:
            near = np.linalg.inv(_scaled(k.astype(float), s)) @ pixels * z
        except np.linalg.LinAlgError:
            continue
        for to_world in (True, False):
            try:
                move = np.linalg.inv(to_pose) @ pose if to_world else to_pose @ np.linalg.inv(pose)
            except np.linalg.LinAlgError:
                continue
            there = move[:3, :3] @ near + move[:3, 3:]
            there = there[:, there[2] > 1e-4]
            uv = (_scaled(to_k.astype(float), s) @ there)[:2] / (there[2] + 1e-6)
            inside = ((uv >= 0) & (uv < np.array([[size[1]], [size[0]]]))).all(axis=0)
            if inside.sum() > best.shape[1]:
                best = uv[:, inside].astype(np.int64)
    if best.shape[1] < LEAST:
        return None
    out = np.zeros(size, bool)
    out[best[1], best[0]] = True
    return closed(dilate(out), 2)


def box_of(mask: np.ndarray) -> list[int] | None:
    """x1, y1, x2, y2 of the pixels set, inclusive."""
    y, x = np.nonzero(mask)
    return [int(x.min()), int(y.min()), int(x.max()), int(y.max())] if len(x) else None


def visible(views: list[tuple[np.ndarray, np.ndarray, np.ndarray]], to_pose: np.ndarray, to_k: np.ndarray, size: tuple[int, int], radius: int = 3) -> np.ndarray:
    """What of the target the views (depth, pose, intrinsics) support; views without geometry are left out."""
    out = np.zeros(size, bool)
    for view in views:
        if any(v is None for v in view):
            continue
        depth, pose, k = view
        seen = carry(usable(np.asarray(depth, np.float32)), depth, pose, k, to_pose, to_k, size)
        if seen is not None:
            out |= seen
    return closed(dilate(out, radius), radius) if out.any() else out


def visible_share(mask: np.ndarray, support: np.ndarray) -> float | None:
    """The share of an object's mask inside the support; None for an empty mask."""
    mask = resized(mask, support.shape) if mask.shape != support.shape else mask
    area = np.count_nonzero(mask)
    return float(np.count_nonzero((mask != 0) & support) / area) if area else None


def carried_boxes(rows: DataFrame) -> DataFrame:
    """(case_id, step, object_id, box) of masks carried to the target view, null where too little arrives.

    ``rows``: case_id, step, object_id, mask (array of bytes), depth, height, width,
    pose, k, to_pose, to_k, to_height, to_width, matrices row by row.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            boxes = []
            for r in part.itertuples(index=False):
                grid = (r.height, r.width)
                m = [np.asarray(v, float).reshape(n, n) for v, n in ((r.pose, 4), (r.k, 3), (r.to_pose, 4), (r.to_k, 3))]
                out = carry(np.asarray(r.mask).reshape(grid), np.asarray(r.depth).reshape(grid), *m, (r.to_height, r.to_width))
                boxes.append(None if out is None else box_of(out))
            yield part[["case_id", "step", "object_id"]].assign(box=boxes)

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"case_id {kinds['case_id']}, step {kinds['step']}, object_id {kinds['object_id']}, box array<int>")


def edges(gray: np.ndarray, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Canny edges of a gray image: 3 by 3 gradients with L1 norm, ridges, hysteresis over eight neighbours."""
    p = np.pad(gray.astype(np.uint8).astype(np.int64), 1, mode="edge")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    columns = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    gx, gy = rows[:, 2:] - rows[:, :-2], columns[2:] - columns[:-2]
    norm = np.abs(gx) + np.abs(gy)
    around = np.pad(norm, 1)
    h, w = norm.shape

    def at(dy: int, dx: int) -> np.ndarray:
        return around[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]

    flat, steep = np.abs(gy) < np.tan(np.pi / 8) * np.abs(gx), np.abs(gy) > np.tan(3 * np.pi / 8) * np.abs(gx)
    falling = (gx < 0) != (gy < 0)
    ridge = np.select(
        [flat, steep, falling],
        [(norm > at(0, -1)) & (norm >= at(0, 1)), (norm > at(-1, 0)) & (norm >= at(1, 0)), (norm > at(-1, 1)) & (norm > at(1, -1))],
        (norm > at(-1, -1)) & (norm > at(1, 1)),
    )
    weak = ridge & (norm > low)
    found = weak & (norm > high)
    while True:
        more = dilate(found) & weak
        if np.array_equal(more, found):
            return found
        found = more


def edge_overlap(a: np.ndarray, b: np.ndarray) -> float:
    """The share of both images' edge pixels within a pixel of the other's; 1 where neither has edges."""
    x, y = edges(a), edges(b)
    total = int(x.sum() + y.sum())
    return 1.0 if total == 0 else float(((x & dilate(y)).sum() + (y & dilate(x)).sum()) / total)
