import json

from test_contract import KINDS, SHA, case

from stepfold.__main__ import main


def test_validate_and_score(spark, tmp_path, capsys):
    m = tmp_path / "m.jsonl"
    m.write_text("".join(json.dumps(case(k)) + "\n" for k in KINDS))
    assert main(["validate", str(m)]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"cases": 3, "steps": 6}
    m.write_text(json.dumps(case("atomic", dataset="x")) + "\n")
    assert main(["validate", str(m)]) == 2 and "dataset" in capsys.readouterr().err
    m.write_text("[]\n")
    assert main(["validate", str(m)]) == 2 and "line 1" in capsys.readouterr().err
    ids = [f"a__b__{k}__step{s + 1}" for k, n in KINDS.items() for s in range(n)]
    (tmp_path / "p").write_text("".join(json.dumps({"id": i, "action_expected": 1.0, "action_abs_err": 0.0, "action_sign_correct": 1.0, "action_unit": "m"}) + "\n" for i in ids))
    (tmp_path / "o").write_text("".join(json.dumps({"id": i, "num_gt_objects": 1, "num_pred_all": 1, "num_matched": 1, "center_error_norm": 0.0, "object_integrity": 1.0}) + "\n" for i in ids))
    given = {"benchmark_version": "0.1", "evaluator_version": "0.1", "manifest_sha256": SHA, "code_commit": "c"}
    assert main(["score", str(tmp_path / "p"), str(tmp_path / "o"), "--provenance", json.dumps(given)]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["overall"] == 1.0


def test_health(spark, capsys):
    assert main(["health"]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["queries"] > 80
