import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfold.operators import rules
from stepfold.sources import binary, discovery, jsonl, sinks


def stream(poses, payload=b"\x01\x02\x03\x04"):
    depth = zlib.compress(struct.pack("<4H", 1, 2, 3, 4))
    out = struct.pack("<IQ", 4, 3) + b"abc" + struct.pack("<64f", *range(64)) + struct.pack("<2i4IfQ", 2, 1, 8, 6, 2, 2, 1000.0, len(poses))
    for k, p in enumerate(poses):
        out += struct.pack("<16f4Q", *p, k, k + 1, len(payload), len(depth)) + payload + depth
    return out


def test_sensor_stream(spark, tmp_path):
    good, bad = list(range(16)), [float("inf")] * 16
    (tmp_path / "a.sens").write_bytes(stream([good, bad, good]))
    df = binary.files(spark, str(tmp_path), "*.sens")
    poses = binary.sensor_poses(df).orderBy("frame").collect()
    assert [r["valid"] for r in poses] == [True, False, True] and poses[0]["pose"] == [float(x) for x in good]
    wanted = df.select("path", F.explode(F.array(F.lit(1), F.lit(2))).alias("frame"))
    frames = binary.sensor_frames(df, wanted).orderBy("frame").collect()
    assert [r["frame"] for r in frames] == [1, 2] and struct.unpack("<4H", bytes(frames[0]["depth"])) == (1, 2, 3, 4)
    head, _ = binary.read_sensor_stream(stream([good]))
    assert head["depth_size"] == (2, 2) and head["frames"] == 1 and head["intrinsic_color"][:2] == [0.0, 1.0]
    with pytest.raises(ValueError):
        list(binary.read_sensor_stream(stream([good, good])[:-3])[1])
    with pytest.raises(ValueError):
        binary.inflate(zlib.compress(b"x" * 100), 10)


def test_arrays_and_archives(spark, tmp_path):
    np.save(tmp_path / "d.npy", np.arange(6, dtype=np.float64).reshape(2, 3))
    one = binary.arrays(binary.files(spark, str(tmp_path), "*.npy")).first()
    assert one["shape"] == [2, 3] and one["values"] == [0, 1, 2, 3, 4, 5]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.txt", "alpha")
        z.writestr("b.txt", "beta")
    rows = binary.archive_members(binary.files(spark, str(tmp_path), "*.zip"), ["b.txt"]).collect()
    assert [(r["member"], bytes(r["content"]), r["crc"]) for r in rows] == [("b.txt", b"beta", zlib.crc32(b"beta"))]


def test_text_sources(spark):
    rows = [("a", "axisAlignment = " + " ".join(map(str, range(16)))), ("a", "other = 1"), ("b", "axisAlignment = 1 2"), ("c", "axisAlignment = " + "1 " * 15 + "nan"), ("d", "axisAlignment = " + "1 " * 16), ("d", "axisAlignment = " + "1 " * 16)]
    got = {r["path"]: r["valid"] for r in binary.key_values(spark.createDataFrame(rows, "path string, value string"), "axisAlignment", 16).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}
    text = '{"w": 4, "h": 3, "fl_x": 1.5, "frames": [{"file_path": "f1", "transform_matrix": [[1.0]]}], "test_frames": [{"file_path": "t1", "transform_matrix": [[2.0]]}]}'
    frames = binary.fisheye_frames(spark.createDataFrame([("p", text)], "path string, text string")).collect()
    assert sorted((r["name"], r["test"], r["w"]) for r in frames) == [("f1", False, 4), ("t1", True, 4)]
    kinds = spark.createDataFrame([(b"\x89PNG\r\n\x1a\n....",), (b"\xff\xd8\xff\xe0",), (b"RIFF....WEBP",), (b"GIF8",)], "c binary").select(binary.image_format(F.col("c")))
    assert [r[0] for r in kinds.collect()] == ["png", "jpeg", "webp", None]
    assert binary.preferred_split(["validation", "train"]) == "train" and binary.preferred_split(["x"]) == "x"


def test_lines(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"k": 1, "s": "x"}\n\n[1]\nnot json\n{"k": 2}\n')
    lines = jsonl.numbered_lines(spark, str(tmp_path / "in.jsonl"))
    good, bad = jsonl.parse_lines(lines, "k int, s string")
    assert [(r["row_no"], r["k"], r["s"]) for r in good.orderBy("row_no").collect()] == [(1, 1, "x"), (5, 2, None)]
    assert [r["row_no"] for r in bad.orderBy("row_no").collect()] == [3, 4]
    jsonl.write_lines(good.select("row_no", "s", "k"), str(tmp_path / "out"), "row_no")
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"k":1,"s":"x"}', '{"k":2,"s":null}']


def test_discovery(spark, tmp_path):
    names = ("c1/step1.png", "c1/step_02.jpg", "c2.png", "c1/notes.txt", "c3_step1.webp", "c3/step1.png", "c5/step03/f1.png", "c5/step03/f2.png", "c6.mp4", "c7/step001.png", "a.b.tiff", "x_step1_step2.bmp", "c8/step1.v2.gif")
    expected = [("c1", 1), ("c1", 2), ("c2", 1), ("c3", 1), ("c4", 1), ("c5", 3), ("c6", 1), ("c6", 2), ("c7", 1), ("a", 4), ("a.b", 1), ("x_step1", 2), ("x", 1), ("c8", 1)]
    want = {("c1", 1): "c1/step1.png", ("c1", 2): "c1/step_02.jpg", ("c2", 1): "c2.png", ("c3", 1): "ambiguous", ("c5", 3): "c5/step03", ("a", 4): "a.b.tiff", ("a.b", 1): "a.b.tiff", ("x_step1", 2): "x_step1_step2.bmp", ("c8", 1): "c8/step1.v2.gif"}
    for top in ("run one/outputs", "plain.d"):
        root = tmp_path / top
        for p in names:
            (root / p).parent.mkdir(parents=True, exist_ok=True)
            (root / p).write_bytes(b"x")
        where = str(tmp_path / top.split("/")[0])
        got = discovery.match_expected(discovery.listing(spark, where), spark.createDataFrame(expected, "case_id string, step int"), None if "outputs" in top else where).collect()
        assert {(r["case_id"], r["step"]): r["artefact"] or r["status"] for r in got} == {k: want.get(k, "missing") for k in expected}


def test_frames_of_segments(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"f{k}.png").write_bytes(b"x")
    (tmp_path / "z.txt").write_bytes(b"x")
    files = discovery.listing(spark, str(tmp_path))

    def chosen(**selection):
        path = discovery.chosen_frames(files, **selection).first()["path"]
        return path and path[-6:-4]

    assert [chosen(), chosen(policy="index", index=1), chosen(policy="index", index=-2), chosen(policy="index", index=6)] == ["f5", "f1", "f4", None]
    assert [chosen(policy="ratio", ratio=r) for r in (0.0, 0.5, 0.7, 1.0)] == ["f0", "f2", "f4", "f5"]
    for bad in ({"policy": "ratio", "ratio": 1.5}, {"policy": "first"}):
        with pytest.raises(ValueError):
            discovery.frame_index(F.lit(1), **bad)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.stage_and_swap(spark.range(3), path)
    sinks.stage_and_swap(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(Exception, match="exists"):
        sinks.write_once(spark.range(1), path)
    sinks.write_document(spark, '{"a": 1}', str(tmp_path / "doc.json"))
    assert (tmp_path / "doc.json").read_text() == '{"a": 1}'
    one = spark.createDataFrame([(0.123456, 1)], "cmg double, n int")
    assert [r["line"] for r in sinks.summary_lines(one, ["cmg", "n"]).collect()] == ["cmg: 0.1235", "n: 1.0000"]
    frames = spark.createDataFrame([("x", 1), ("x", 2)], "image_ref string, k int")
    with pytest.raises(ValueError, match="repeated"):
        sinks.frame_index(frames, ["image_ref"])
    with pytest.raises(ValueError, match="missing columns: pose"):
        sinks.frame_index(frames, ["pose"])


def test_rules(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", None, 2.0), ("c", 3, None)], "id string, n int, x double")
    checks = [rules.Rule("n", F.col("n") > 0, 1), rules.Rule("x", F.col("x") <= 1, 0)]
    found = rules.violations(df, ["id"], checks)
    assert sorted((r["id"], r["rule"]) for r in found.collect()) == [("b", "n"), ("b", "x"), ("c", "x")]
    assert rules.first_violation(found, ["id"]).first()["rule"] == "x"
    with pytest.raises(ValueError, match="^x"):
        rules.assert_clean(found, ["id"])
    rules.assert_clean(found.filter("false"), ["id"])
    good, bad = rules.quarantine(df, checks)
    assert [r["id"] for r in good.collect()] == ["a"] and {r["id"]: r["broken"] for r in bad.collect()} == {"b": ["n", "x"], "c": ["x"]}
