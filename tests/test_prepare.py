import json

import pytest
from pyspark.sql import functions as F

from stepfold import __main__ as cli
from stepfold import prepare, schema
from test_contract import case, table

POSE = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]
K = [[5.0, 0, 2], [0, 5.0, 2], [0, 0, 1]]


def cases():
    """Three cases, each frame with an id of its own."""
    rows, n = [case("atomic", 2), case("chain"), case("cycle")], 0
    for r in rows:
        for x in r["input_images"] + r["target_images"]:
            x["frame_id"], n = str(n), n + 1
    return rows


def world(spark, tmp_path, rows=None):
    rows = rows or cases()
    refs = sorted({x["image_path"] for r in rows for x in r["input_images"] + r["target_images"]})
    (tmp_path / "raw").mkdir(exist_ok=True)
    sources, cameras = [], []
    for k, ref in enumerate(refs):
        for kind, suffix in (("rgb", "png"), ("depth", "npy")):
            (tmp_path / f"raw/{k}_{kind}.{suffix}").write_bytes(f"{kind} {k}".encode())
        sources.append({"image_ref": ref, "image_path": f"${{raw}}/{k}_rgb.png", "depth_path": f"${{raw}}/{k}_depth.npy"})
        cameras.append({"image_ref": ref, "extrinsics_c2w": POSE, "intrinsics": K, "image_height": 4, "image_width": 4})
    for name, data in (("manifest", rows), ("sources", sources), ("cameras", cameras)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in data))
    return refs


def call(*args):
    return cli.main([str(a) for a in args])


def build(tmp_path, *more):
    return call("build", tmp_path / "manifest.jsonl", tmp_path / "sources.jsonl", tmp_path / "cameras.jsonl", f"file://{tmp_path}/out", "--revision", "r1", "--root", f"raw=file://{tmp_path}/raw", *more)


@pytest.fixture
def keep(spark, monkeypatch):
    # the commands use the tests' session
    return spark


def test_build_verify_and_resume(keep, tmp_path, capsys):
    refs = world(keep, tmp_path)
    assert build(tmp_path) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["status"] == "built" and report["frames"] == len(refs) and report["stages"] == ["copies", "index", "requests"]
    index = keep.read.parquet(f"{tmp_path}/out/eval_frames")
    row = index.filter(F.col("image_ref") == refs[0]).first()
    with open(row["image_path"].removeprefix("file://"), "rb") as f:
        assert f.read() == b"rgb 0"
    assert call("verify", f"{tmp_path}/out/eval_frames", tmp_path / "manifest.jsonl") == 0
    capsys.readouterr()
    # a run that is there is not overwritten, a resumed one takes its stages over
    assert build(tmp_path) == 2 and "already" in capsys.readouterr().err
    assert build(tmp_path, "--resume") == 0 and json.loads(capsys.readouterr().out)["reused"] == ["requests", "copies", "index"]
    (tmp_path / "sources.jsonl").write_text((tmp_path / "sources.jsonl").read_text().replace("0_rgb", "1_rgb"))
    assert build(tmp_path, "--resume") == 2 and "same configuration" in capsys.readouterr().err


def test_problems_are_listed_together(keep, tmp_path, capsys):
    refs = world(keep, tmp_path)
    lines = (tmp_path / "sources.jsonl").read_text().splitlines()
    (tmp_path / "sources.jsonl").write_text("\n".join(lines[2:] + [lines[5]]) + "\n")
    cameras = (tmp_path / "cameras.jsonl").read_text().splitlines()
    (tmp_path / "cameras.jsonl").write_text("\n".join(cameras[:-1]) + "\n")
    assert build(tmp_path) == 2
    said = capsys.readouterr().err
    assert f"source_missing: {refs[0]}, {refs[1]}" in said and f"source_repeated: {refs[5]}" in said and f"camera_missing: {refs[-1]}" in said
    assert not (tmp_path / "out/eval_frames").exists()
    world(keep, tmp_path)
    (tmp_path / "raw/3_rgb.png").unlink()
    assert build(tmp_path) == 2 and "configuration" not in (said := capsys.readouterr().err) or "already" in said


def test_verify_against_a_reference(keep, tmp_path, capsys):
    refs = world(keep, tmp_path)
    assert build(tmp_path) == 0
    index = keep.read.parquet(f"{tmp_path}/out/eval_frames")
    index.write.parquet(f"{tmp_path}/same.parquet")
    index.withColumn("rgb_sha256", F.when(F.col("image_ref") == refs[1], "x").otherwise(F.col("rgb_sha256"))).filter(F.col("image_ref") != refs[2]).write.parquet(f"{tmp_path}/other.parquet")
    capsys.readouterr()
    assert call("verify", f"{tmp_path}/out/eval_frames", tmp_path / "manifest.jsonl", "--reference", f"{tmp_path}/same.parquet") == 0
    assert json.loads(capsys.readouterr().out) == {"status": "verified", "frames": len(refs), "reference_checked": True}
    assert call("verify", f"{tmp_path}/out/eval_frames", tmp_path / "manifest.jsonl", "--reference", f"{tmp_path}/other.parquet") == 2
    assert capsys.readouterr().err == f"error: differs:rgb_sha256: {refs[1]}; not_in_reference: {refs[2]}\n"
    manifest = table(keep, cases(), schema.MANIFEST)
    assert prepare.verify(index.withColumn("loader_frame_idx", F.col("loader_frame_idx") + 1), manifest) == [f"identity: {', '.join(refs[:5])} +{len(refs) - 5} more"]


def test_other_commands(keep, tmp_path, capsys):
    refs = world(keep, tmp_path)
    assert call("frames", tmp_path / "manifest.jsonl", "--out", tmp_path / "frames") == 0
    assert json.loads(capsys.readouterr().out) == {"datasets": {"scannet": {"frames": len(refs), "scenes": 1}}, "conflicts": 0}
    assert [json.loads(r[0])["image_ref"] for r in keep.read.text(f"{tmp_path}/frames").collect()] == refs
    (tmp_path / "plan.jsonl").write_text('{"dataset": "a", "path": "x", "alternatives": ["y"]}\n{"dataset": "a", "path": "z"}\n')
    (tmp_path / "good.jsonl").write_text('{"path": "y"}\n')
    (tmp_path / "there.jsonl").write_text('{"path": "z"}\n')
    assert call("delivery", tmp_path / "plan.jsonl", tmp_path / "good.jsonl", tmp_path / "there.jsonl") == 2
    assert json.loads(capsys.readouterr().out) == [{"dataset": "a", "status": "missing-inputs", "files": 2, "missing": 1, "unverified": 1}]
    bank = [{"sample_id": r["sample_id"], "target_labels": [{"object_labels": ["tv"]} for _ in r["target_images"]]} for r in cases()]
    (tmp_path / "bank.jsonl").write_text("".join(json.dumps(r) + "\n" for r in bank))
    assert call("labels", tmp_path / "bank.jsonl", tmp_path / "manifest.jsonl") == 0
    (tmp_path / "bank.jsonl").write_text("".join(json.dumps(r) + "\n" for r in [*bank, bank[0]]))
    assert call("labels", tmp_path / "bank.jsonl", tmp_path / "manifest.jsonl") == 2 and "repeated" in capsys.readouterr().err
    steps = [{"case_id": r["sample_id"], "step_id": i + 1, "output_path": f"{r['sample_id']}/{i}.png", "output_sha256": "a" * 64} for r in cases() for i in range(len(r["instructions"]))]
    (tmp_path / "made.jsonl").write_text("".join(json.dumps(r) + "\n" for r in steps[::-1]))
    assert call("predictions", tmp_path / "manifest.jsonl", tmp_path / "made.jsonl", tmp_path / "pred", "--model-id", "m", "--model-type", "image", "--sha256", "b" * 64) == 0
    rows = [json.loads(r[0]) for r in keep.read.text(f"{tmp_path}/pred").collect()]
    assert [(r["case_id"], r["step_id"]) for r in rows] == [(s["case_id"], s["step_id"]) for s in steps]
    capsys.readouterr()
    (tmp_path / "s.yaml").write_text("evaluator:\n  device: gpu\n  match_policy: strict\n")
    assert call("settings", "--config", tmp_path / "s.yaml", "--set", "device=tpu") == 0
    got = json.loads(capsys.readouterr().out)
    assert (got["device"], got["match_policy"], got["pose_backend"]) == ("tpu", "strict", "table")
    assert call("settings", "--set", "device") == 2


def test_scores_of_a_resumed_run(keep, tmp_path, capsys):
    ids = [f"host__{k}__{s}__step1" for k, s in enumerate(("atomic", "chain", "cycle"))]
    (tmp_path / "pose.jsonl").write_text("".join(json.dumps({"id": i, "action_expected": 1.0, "action_abs_err": 0.0, "action_sign_correct": 1.0, "action_unit": "m"}) + "\n" for i in ids))
    (tmp_path / "objects.jsonl").write_text("".join(json.dumps({"id": i, "num_gt_objects": 2, "num_pred_all": 2, "num_matched": 2, "center_error_norm": 0.0, "object_integrity": 1.0, "relative_topology": 1.0}) + "\n" for i in ids))
    args = ["score", tmp_path / "pose.jsonl", tmp_path / "objects.jsonl", "--provenance", json.dumps({k: "x" for k in ("benchmark_version", "evaluator_version", "manifest_sha256", "code_commit")}), "--run", f"{tmp_path}/run"]
    assert call(*args) == 0
    first = json.loads(capsys.readouterr().out)
    assert first["overall"] == 1.0 and json.loads((tmp_path / "run/result.json").read_text()) == first
    assert call(*args) == 2 and "already" in capsys.readouterr().err
    assert call(*args, "--resume") == 0 and json.loads(capsys.readouterr().out) == first
    assert json.loads((tmp_path / "run/run_manifest.json").read_text())["reused"] == ["result"]
