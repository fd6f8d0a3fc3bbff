"""Scene tables in one shape: (scene_id, frame, name, pose, k) and depth maps in metres.

Archives of arrays are read here.  Pickled and HDF5 scene files are converted to
Parquet outside (pickles are not safe to load); what they hold is turned into the
same shape by column expressions, and raw depth by one Arrow-fed kernel.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import camera
from ..functions.images import clip_outliers, half_size, resized


class Recipe(NamedTuple):
    """How a dataset's raw depth becomes metres: divisor, clipped, resized to the halved image, halved."""

    divisor: float
    clip: bool
    to_image: bool
    half: bool
    k_scale: float


#: Fixed values of the four datasets.
RECIPES = {
    "scannetpp": Recipe(1000.0, True, False, True, 0.5),
    "scannet": Recipe(1000.0, True, True, True, 0.25),
    "hypersim": Recipe(1.0, True, True, False, 0.5),
    "matterport3d": Recipe(4000.0, False, False, True, 0.5),
}
#: Other names of a dataset.
ALIASES = {"matterport": "matterport3d", "mp3d": "matterport3d"}


def dataset_key(name: str | None) -> str:
    key = (name or "").lower()
    key = ALIASES.get(key, key)
    if key not in RECIPES:
        raise KeyError(f"no recipe for dataset {name!r}")
    return key


def metres(raw: np.ndarray, dataset: str, image: tuple[int, int]) -> np.ndarray:
    """Depth in metres on the frame's final grid; ``image`` is the RGB image's height and width.

    Resizing before clipping and after it follows the dataset: a nearest resize keeps
    values, so it comes first, and halving takes means of clipped depths.
    """
    r = RECIPES[dataset_key(dataset)]
    depth = np.nan_to_num(raw.astype(np.float32) / np.float32(r.divisor), nan=0.0, posinf=0.0, neginf=0.0) if r.clip else raw.astype(np.float32) / np.float32(r.divisor)
    half = (round(image[0] / 2), round(image[1] / 2))
    if r.to_image and not r.half:  # clipped on its own grid
        return resized(clip_outliers(depth), half).astype(np.float32)
    if r.to_image:
        depth = resized(depth, half)
    depth = clip_outliers(depth) if r.clip else depth
    return half_size(depth).astype(np.float32)


def depth_maps(frames: DataFrame) -> DataFrame:
    """(scene_id, frame, shape, depth, most) of raw depth (dataset, scene_id, frame, raw, height, width, image_height, image_width)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [metres(np.asarray(r.raw, np.float32).reshape(r.height, r.width), r.dataset, (r.image_height, r.image_width)) for r in part.itertuples(index=False)]
            yield part[["scene_id", "frame"]].assign(shape=[list(d.shape) for d in out], depth=[d.ravel() for d in out], most=[float(d.max()) if d.size else 0.0 for d in out])

    kinds = dict(frames.dtypes)
    return frames.mapInPandas(run, f"scene_id {kinds['scene_id']}, frame {kinds['frame']}, shape array<int>, depth array<float>, most double")


def depth_path(dataset: Column, rgb: Column) -> Column:
    """Where a dataset keeps the depth of an RGB image; null where the name is not of its form."""
    plus = F.regexp_replace(rgb, r"/[^/]+/([^/]+)\.[^./]+$", "/depth/$1.png")
    scan = F.regexp_replace(rgb, r"\.[^./]+$", ".png")
    number = F.regexp_extract(rgb, r"/frame\.(\d+)\.color\.jpg$", 1)
    folder = F.regexp_replace(F.regexp_replace(rgb, r"/[^/]+$", ""), r"_final_preview(?=[^/]*$)", "_geometry_hdf5")
    hyper = F.when(number != "", F.concat(folder, F.lit("/frame."), F.lpad(number.cast("int").cast("string"), 4, "0"), F.lit(".depth_meters.hdf5")))
    matter = F.when(rgb.rlike(r"_i[0-9]+_[0-9]+\.jpg$"), F.regexp_replace(rgb, r"/[^/]+/([^/]+)_i([0-9]+_[0-9]+)\.jpg$", "/matterport_depth_images/$1_d$2.png"))
    key = F.lower(dataset)
    return F.when(key == "scannetpp", plus).when(key == "scannet", scan).when(key == "hypersim", hyper).when(key.isin("matterport3d", *ALIASES), matter)


def array_archives(npz: DataFrame) -> DataFrame:
    """(path, name, pose, k) of scene metadata archives (path, content): a row for each trajectory entry.

    The archive holds ``images``, ``trajectories`` (n x 4 x 4) and ``intrinsics``
    (n x 3 x 3 or larger); pickled objects are refused.  Names lose their suffix.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in part[["path", "content"]].itertuples(index=False, name=None):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    lost = {"images", "trajectories", "intrinsics"} - set(z.files)
                    if lost:
                        raise ValueError(f"{path}: no {', '.join(sorted(lost))}")
                    pose, k, names = z["trajectories"], z["intrinsics"], z["images"]
                n = len(pose)
                if len(k) < n or len(names) < n:
                    raise ValueError(f"{path}: fewer names or intrinsics than poses")
                rows = {"path": path, "name": [str(x).split(".")[0] for x in names[:n]], "pose": list(pose.reshape(n, 16).astype(float)), "k": list(k[:n, :3, :3].reshape(n, 9).astype(float))}
                yield pd.DataFrame(rows)

    return npz.select("path", "content").mapInPandas(run, "path string, name string, pose array<double>, k array<double>")


def unit_scale(lines: DataFrame, file: str = "path") -> DataFrame:
    """(path, scale) of metadata CSV lines (path, value): ``meters_per_asset_unit``, 1 where it is not given."""
    cell = F.split("value", ",")
    value = F.when(F.trim(cell[0]) == "meters_per_asset_unit", F.trim(F.get(cell, F.lit(1))).try_cast("double"))
    return lines.groupBy(file).agg(F.coalesce(F.first(value, ignorenulls=True), F.lit(1.0)).alias("scale"))


def oriented_pose(orientation: Column, position: Column, scale: Column) -> Column:
    """A pose (4x4) of a 3x3 orientation and a position in asset units, its axes turned to the vision convention."""
    rows = [F.array(*(orientation[i][j] for j in range(3)), position[i] * scale) for i in range(3)]
    return camera.flip_axes(F.array(*rows, F.array(*(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)))))


def product(a: Column, b: Column) -> Column:
    """The matrix product of two 4x4 arrays of arrays."""
    return F.array(*(F.array(*(sum((a[i][n] * b[n][j] for n in range(1, 4)), a[i][0] * b[0][j]) for j in range(4))) for i in range(4)))


def calibrations(annotations: DataFrame, requests: DataFrame, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Calibrations of the requested images, and the requests whose annotations are in conflict.

    ``annotations``: dataset, sample, image_key, pose, k, axis_align (arrays of arrays),
    of a converted annotation file; ``requests``: dataset, scene_id, image_key.  Only
    scannet poses are aligned to the scene's axes.  An image may be listed in several
    rooms: where the request names a region, the sample's last part must be it.
    Equal calibrations given twice are one; different ones are a conflict.
    """
    a = annotations.filter(F.col("dataset").isin("scannet", "matterport3d"))
    a = a if scope is None else a.filter(F.col("dataset") == scope)
    pose = F.when(F.col("dataset") == "scannet", product(F.col("axis_align"), F.col("pose"))).otherwise(F.col("pose"))
    a = a.select("dataset", "image_key", F.element_at(F.split("sample", "/"), -1).alias("room"), pose.alias("pose"), "k")
    region = F.regexp_extract("scene_id", r"(?:^|_)region(\d+)$", 1)
    joined = requests.select("dataset", "scene_id", "image_key").distinct().join(a, ["dataset", "image_key"])
    joined = joined.filter((F.col("dataset") != "matterport3d") | (region == "") | (F.col("room") == F.concat(F.lit("region"), region)))
    valid = F.forall(F.flatten("pose"), lambda v: F.abs(v) < float("inf")) & F.forall(F.flatten("k"), lambda v: F.abs(v) < float("inf"))
    one = joined.filter(valid).groupBy("dataset", "scene_id", "image_key").agg(F.min(F.struct("pose", "k")).alias("low"), F.max(F.struct("pose", "k")).alias("high"))
    good = one.filter(F.col("low").eqNullSafe(F.col("high"))).select("dataset", "scene_id", "image_key", "low.pose", "low.k")
    return good, one.filter(~F.col("low").eqNullSafe(F.col("high"))).select("dataset", "scene_id", "image_key")
