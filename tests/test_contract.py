import json

import pytest
from pyspark.sql import functions as F

from stepfold import schema
from stepfold.operators import contract, rules

SHA = "a" * 64
KINDS = {"atomic": 1, "chain": 3, "cycle": 2}


def image(path):
    return {"role": "view", "image_path": path, "frame_id": "7"}


def case(kind, k=1, **change):
    name, n = f"scene__x__{kind}", KINDS[kind]
    row = {
        "sample_id": name, "root_sample_id": name, "dataset": "scannet", "scene_id": "s", "context_type": "single", "num_context_images": k, "instruction_type": kind, "subtype": kind,
        "input_images": [image(f"{name}/in{i}") for i in range(k)], "target_images": [image(f"{name}/t{i}") for i in range(n)],
        "instructions": [{"step": i + 1, "text": f"go {i}"} for i in range(n)], "evaluation_protocol": {"call_mode": "step", "num_model_calls": n, "use_teacher_forcing": False}, "pose_metadata": "{}",
    }
    return row | change


def table(spark, rows, ddl):
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "row_no bigint, line string")
    return lines.select("row_no", F.from_json("line", ddl).alias("r")).select("row_no", "r.*")


def manifest(spark, rows=None):
    return table(spark, rows or [case("atomic", 2), case("chain"), case("cycle")], schema.MANIFEST)


def predictions(spark, change=lambda rows: rows):
    rows = [
        {"benchmark_version": "0.1", "manifest_sha256": SHA, "model_id": "m", "model_type": "image", "case_id": f"scene__x__{k}", "step_id": s + 1, "output_path": f"o/{k}{s}.png", "output_sha256": SHA, "interface_type": "image-editing", "input_ids": ["a"], "prompt_sha256": SHA}
        for k, n in KINDS.items()
        for s in range(n)
    ]
    return table(spark, change(rows), schema.PREDICTION)


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({"dataset": "other"}, "dataset"),
        ({"sample_id": "bad id"}, "safe_id"),
        ({"num_context_images": 2}, "context_count"),
        ({"instructions": [{"step": 2, "text": "x"}]}, "contiguous_steps"),
        ({"target_images": [image("a"), image("b")]}, "target_count"),
        ({"evaluation_protocol": {"call_mode": "s", "num_model_calls": 2, "use_teacher_forcing": True}}, "call_count"),
        ({"target_images": [image("scene__x__atomic/in0")]}, "leakage"),
        ({"scene_id": ""}, "scene_id"),
        ({"pose_metadata": "[]"}, "pose_metadata"),
    ],
)
def test_manifest_rules(spark, change, rule):
    assert [r["rule"] for r in contract.check_manifest(manifest(spark, [case("atomic", **change)])).collect()] == [rule]


def test_clean_manifest_and_repeats(spark):
    assert contract.check_manifest(manifest(spark)).isEmpty()
    assert [(r["row_no"], r["rule"]) for r in contract.check_manifest(manifest(spark, [case("chain"), case("chain")])).collect()] == [(1, "repeated_id")]


def test_expected_steps(spark):
    rows = contract.expected_steps(manifest(spark)).orderBy("row_no", "step_no").collect()
    assert [r["id"] for r in rows][:3] == ["scene__x__atomic__step1", "scene__x__chain__step1", "scene__x__chain__step2"]
    assert rows[2]["current_path"] == "scene__x__chain/t0" and rows[0]["context_paths"] == ["scene__x__atomic/in1"]


def edit(i, **change):
    return lambda rows: [r | (change if k == i else {}) for k, r in enumerate(rows)]


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        (edit(1, output_path="/abs"), "output_path"),
        (edit(2, output_path="a/../b"), "output_path"),
        (edit(0, manifest_sha256="b" * 64), "other_manifest"),
        (edit(3, model_id="n"), "mixed_models"),
        (lambda rows: [rows[0], *rows], "repeated"),
        (edit(5, case_id="none", step_id=9), "unexpected"),
        (lambda rows: rows[:-1], "missing"),
        (lambda rows: [rows[1], rows[0], *rows[2:]], "order"),
    ],
)
def test_prediction_rules(spark, change, rule):
    found = contract.check_predictions(predictions(spark, change), manifest(spark), SHA)
    assert rules.first_violation(found, ["row_no"]).first()["rule"] == rule


def test_clean_predictions(spark):
    p = predictions(spark)
    assert contract.check_predictions(p, manifest(spark), SHA).isEmpty()
    digests = p.select("output_path", F.when(F.col("row_no") == 2, "x").otherwise(SHA).alias("sha256"))
    found = contract.check_predictions(p, manifest(spark), SHA, digests)
    assert [(r["rule"], r["row_no"]) for r in found.collect()] == [("digest", 2)]
    assert contract.prediction_report(found, p).first().asDict() == {"missing": 0, "repeated": 0, "unexpected": 0, "digest": 1, "total": 6}


def test_build_predictions_pass_their_own_check(spark):
    m = manifest(spark)
    made = predictions(spark).select("case_id", "step_id", "output_path", "output_sha256")
    built = contract.build_predictions(m, made, "m", "world_model", SHA)
    assert {r["interface_type"] for r in built.collect()} == {"autoregressive-rollout"} and built.count() == 6
    rows = {(r["case_id"], r["step_id"]): r["input_ids"] for r in built.collect()}
    assert rows["scene__x__atomic", 1] == ["scene__x__atomic:input:1", "scene__x__atomic:input:2"] and rows["scene__x__cycle", 2] == ["scene__x__cycle:generated:step1"]


def test_evaluator_input_and_labels(spark):
    m = manifest(spark)
    bank = [{"sample_id": f"scene__x__{k}", "target_labels": [{"detector_prompt_labels": [], "object_labels": ["A Chair", "wall"]} for _ in range(n)]} for k, n in KINDS.items()]
    labels = table(spark, bank, schema.LABELS).drop("row_no")
    rows = contract.evaluator_input(m, predictions(spark), labels).collect()
    assert len(rows) == 6 and all(r["object_prompts"] == ["chair"] and r["generated_path"] for r in rows)
    assert contract.check_label_bank(labels, m).isEmpty()
    bad = table(spark, [bank[0] | {"target_labels": []}, bank[1], bank[1]], schema.LABELS).drop("row_no")
    assert sorted((r["sample_id"][-6:], r["rule"]) for r in contract.check_label_bank(bad, m).collect()) == [("_chain", "repeated"), ("atomic", "labels"), ("atomic", "length")]


def test_frames(spark):
    m = manifest(spark)
    refs = [r[0] for r in m.select(F.explode(F.concat("input_images", "target_images")).alias("x")).select("x.image_path").collect()]
    eye = [[float(i == j) for j in range(4)] for i in range(4)]
    rows = [{"asset_id": f"a{i}", "dataset": "d", "scene_id": "s", "image_ref": r, "loader_frame_idx": i, "image_height": 4, "image_width": 4, "extrinsics_c2w": eye, "intrinsics": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], "asset_revision": "r1"} for i, r in enumerate(refs)]
    assert contract.check_frames(table(spark, rows, schema.FRAME), m).isEmpty()
    rows[0]["extrinsics_c2w"] = [[0.0] * 4] * 4
    rows[1] |= {"image_ref": "elsewhere", "asset_revision": "r2"}
    rows[2]["asset_id"] = rows[3]["asset_id"]
    assert sorted(r["rule"] for r in contract.check_frames(table(spark, rows, schema.FRAME), m).collect()) == ["not_covered", "not_needed", "pose", "repeated_asset", "revision"]


def test_result(spark):
    ids = [f"scene__x__{k}__step{s + 1}" for k, n in KINDS.items() for s in range(n)]
    pose = spark.createDataFrame([(i, "c", 1.0, 1.0, 0.0, 1.0, "m") for i in ids], schema.POSE_RECORD)
    obj = spark.createDataFrame([(i, 2, 2, 2, 0.0, 1.0, 1.0) for i in ids], "id string, num_gt_objects int, num_pred_all int, num_matched int, center_error_norm double, object_integrity double, relative_topology double")
    given = {"benchmark_version": "0.1", "evaluator_version": "0.1", "manifest_sha256": SHA, "code_commit": "c"}
    one = contract.score_predictions(manifest(spark), predictions(spark), pose, obj, given).first()
    assert one["overall"] == one["cmg"] == one["ssp"] == 1.0 and one["eligible"] == 6
    with pytest.raises(Exception, match="missing subtype"):
        contract.result(pose.filter("id NOT LIKE '%chain%'"), obj, given).collect()
    with pytest.raises(ValueError, match="one_family"):
        contract.score_predictions(manifest(spark), predictions(spark), pose, obj.limit(5), given)


def test_leakage_of_many_short_items(spark, tmp_path):
    from stepfold.plans.contracts import content_leakage

    texts = ["one two three four five six seven", "xalpha betas end", "", "k500 and k17x", None, "a b c d"]
    items = [f"k{i}" for i in range(1500)] + ["alpha beta", "wo three fo", "two three four five si", "", "b c", "three five", "one two three four five six seve", "x" * 30]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in content_leakage(spark, str(tmp_path)).collect())
    assert got == sorted((d, i) for d, t in enumerate(texts) if t is not None for i, x in enumerate(items) if x in t)
