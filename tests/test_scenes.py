import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfold.sources import binary, files, scenes


def test_metres():
    raw = np.full((8, 8), 2000.0)
    raw[0, 0] = 60000
    assert np.allclose(scenes.metres(raw, "scannetpp", (8, 8))[1:], 2.0)
    assert scenes.metres(raw, "scannetpp", (8, 8))[0, 0] == 1.5  # the outlier counts as 0 in the mean
    assert scenes.metres(raw, "mp3d", (8, 8))[0, 0] == np.float32((60000 + 3 * 2000) / 16000)
    assert scenes.metres(raw, "scannet", (16, 16)).shape == (4, 4)
    raw[1, 1] = np.inf
    assert scenes.metres(raw / 1000, "Hypersim", (16, 12)).shape == (8, 6)
    with pytest.raises(KeyError):
        scenes.metres(raw, "other", (8, 8))


def test_depth_maps(spark):
    schema = "dataset string, scene_id string, frame int, raw array<float>, height int, width int, image_height int, image_width int"
    df = spark.createDataFrame([("matterport3d", "s", 3, [4000.0] * 16, 4, 4, 4, 4)], schema)
    one = scenes.depth_maps(df).first()
    assert (one["frame"], one["shape"], one["depth"], one["most"]) == (3, [2, 2], [1.0] * 4, 1.0)


def test_depth_paths(spark):
    rows = [
        ("scannetpp", "/d/s/images/a.b.jpg", "/d/s/depth/a.b.png"),
        ("ScanNet", "/d/s/00010.jpg", "/d/s/00010.png"),
        ("hypersim", "/d/images/scene_cam_00_final_preview/frame.0007.color.jpg", "/d/images/scene_cam_00_geometry_hdf5/frame.0007.depth_meters.hdf5"),
        ("hypersim", "/d/x/other.jpg", None),
        ("mp3d", "/d/color/abc_i1_2.jpg", "/d/matterport_depth_images/abc_d1_2.png"),
        ("matterport3d", "/d/color/abc.jpg", None),
        ("other", "/d/a.jpg", None),
    ]
    df = spark.createDataFrame(rows, "dataset string, rgb string, want string").withColumn("got", scenes.depth_path(F.col("dataset"), F.col("rgb")))
    assert [(r["rgb"], r["got"]) for r in df.collect()] == [(r[1], r[2]) for r in rows]


def test_archives(spark, tmp_path):
    np.savez(tmp_path / "scene_metadata.npz", images=np.array(["b.jpg", "a.x.jpg"]), trajectories=np.arange(32.0).reshape(2, 4, 4), intrinsics=np.arange(18.0).reshape(2, 3, 3))
    rows = scenes.array_archives(binary.files(spark, str(tmp_path), "*.npz")).orderBy("name").collect()
    assert [r["name"] for r in rows] == ["a", "b"] and rows[1]["pose"] == list(range(16)) and rows[0]["k"] == list(range(9, 18))
    np.savez(tmp_path / "scene_metadata.npz", images=np.array(["b"]))
    with pytest.raises(Exception, match="no intrinsics, trajectories"):
        scenes.array_archives(binary.files(spark, str(tmp_path), "*.npz")).collect()


def test_oriented_poses(spark):
    lines = spark.createDataFrame([("p", "name, x"), ("p", "meters_per_asset_unit, 0.5"), ("q", "name, 1")], "path string, value string")
    assert {r["path"]: r["scale"] for r in scenes.unit_scale(lines).collect()} == {"p": 0.5, "q": 1.0}
    df = spark.createDataFrame([([[1.0, 2.0, 3.0]] * 3, [10.0, 20.0, 30.0])], "o array<array<double>>, p array<double>")
    pose = df.select(scenes.oriented_pose(F.col("o"), F.col("p"), F.lit(0.1))).first()[0]
    assert pose[1] == [1.0, -2.0, -3.0, 2.0] and pose[3][3] == 1.0


def test_calibrations(spark):
    eye = np.eye(4)
    far, bad = eye * 2, eye.copy()
    bad[0, 0] = np.nan
    k = np.eye(3).tolist()
    schema = "dataset string, sample string, image_key string, pose array<array<double>>, k array<array<double>>, axis_align array<array<double>>"
    turn = np.array([[0.0, -1, 0, 1], [1, 0, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]])
    pose = np.array([[1.0, 0, 0, 5], [0, 1, 0, 6], [0, 0, 1, 7], [0, 0, 0, 1]])
    rows = [
        ("scannet", "scannet/s1", "s1/a", pose, turn),
        ("scannet", "scannet/s1", "s1/a", pose, turn),
        ("scannet", "scannet/s1", "s1/b", pose, eye),
        ("scannet", "scannet/s1", "s1/b", far, eye),
        ("scannet", "scannet/s1", "s1/c", bad, eye),
        ("matterport3d", "matterport3d/h/region1", "h/a", pose, turn),
        ("matterport3d", "matterport3d/h/region2", "h/a", far, turn),
        ("other", "x", "h/a", far, eye),
    ]
    a = spark.createDataFrame([(d, s, i, p.tolist(), k, t.tolist()) for d, s, i, p, t in rows], schema)
    wanted = [("scannet", "s1", "s1/a"), ("scannet", "s1", "s1/b"), ("scannet", "s1", "s1/c"), ("matterport3d", "h_region1", "h/a"), ("matterport3d", "h", "h/a")]
    good, bad = scenes.calibrations(a, spark.createDataFrame(wanted, "dataset string, scene_id string, image_key string"))
    got = {(r["scene_id"], r["image_key"]): r["pose"] for r in good.collect()}
    assert got == {("s1", "s1/a"): (turn @ pose).tolist(), ("h_region1", "h/a"): pose.tolist()}
    assert {(r["scene_id"], r["image_key"]) for r in bad.collect()} == {("s1", "s1/b"), ("h", "h/a")}
    good, _ = scenes.calibrations(a, spark.createDataFrame(wanted, "dataset string, scene_id string, image_key string"), "matterport3d")
    assert good.count() == 1


def test_copies(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"abc")
    (tmp_path / "e.png").write_bytes(b"")
    to = str(tmp_path / "out")
    df = spark.createDataFrame([("c1", 1, "a.PNG"), ("c1", 2, "e.png"), ("c2", 1, "lost.png"), ("c3", 1, "a"), ("c3", 1, "b")], "case_id string, n int, name string")
    df = df.select(F.concat(F.lit(f"{tmp_path}/"), "name").alias("source"), F.concat(F.lit(f"{to}/"), files.case_path(F.col("case_id"), "input", F.col("n"), F.col("name"))).alias("destination"))
    odd = spark.createDataFrame([(f"{tmp_path}/a.PNG", f"{to}/x.jpg")], df.schema)
    for _ in range(2):  # a task that runs again does no harm
        got = {r["destination"].removeprefix(f"{to}/"): r["status"] for r in files.copy_files(df.union(odd)).collect()}
        assert got == {"cases/c1/input_1.png": "copied", "cases/c1/input_2.png": "empty", "cases/c2/input_1.png": "missing", "cases/c3/input_1.bin": "repeated", "x.jpg": "suffix"}
    assert [p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()] == [b"abc"]
    one = files.copy_files(df.filter(F.col("source").endswith("PNG"))).first()
    assert (one["bytes"], one["sha256"]) == (3, hashlib.sha256(b"abc").hexdigest())
    assert files.copy_files(df.filter(F.col("source").endswith("PNG")), link=True).first()["status"] == "linked"
    assert (tmp_path / "out/cases/c1/input_1.png").is_symlink()


def test_written_images(spark, tmp_path):
    png, jpg = b"\x89PNG\r\n\x1a\n....", b"\xff\xd8\xff\xe0...."
    good = hashlib.sha256(png).hexdigest()
    rows = [("a.1", png, good.upper()), ("b", jpg, None), ("c", png, "0" * 64), ("d", png, "short"), ("e", None, None), ("f", None, good), ("g", b"text", None), ("h", png, None), ("h", jpg, None)]
    df = spark.createDataFrame(rows, "stem string, content binary, expected string")
    got = sorted((r["stem"], r["status"]) for r in files.write_images(df, str(tmp_path)).collect())
    assert got == [("a.1", "written"), ("b", "written"), ("c", "digest"), ("d", "digest"), ("e", "null"), ("f", "lost"), ("g", "format"), ("h", "repeated"), ("h", "repeated")]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.1.png", "b.jpg"] and (tmp_path / "a.1.png").read_bytes() == png
