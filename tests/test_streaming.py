import json

from stepfold.streaming import predictions


def drain(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def rows():
    return [{"case_id": c, "step_id": s, "score": s / 10, "arrived": f"2024-01-01T00:0{s}:00"} for c in ("a", "b") for s in (1, 2, 3) if (c, s) != ("b", 3)]


def test_distinct_steps_match_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/1.json", rows())
    write(tmp_path / "in/2.json", rows()[:3] + [{"case_id": "c", "step_id": 0, "score": 0.1, "arrived": "2024-01-01T00:01:00"}])
    got = drain(predictions.distinct_steps(predictions.arriving(spark, str(tmp_path / "in"), files_per_trigger=1)), "steps_once", tmp_path)
    assert sorted((r["case_id"], r["step_id"]) for r in got) == sorted((r["case_id"], r["step_id"]) for r in rows())


def test_cases_are_told_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/1.json", rows())
    write(tmp_path / "in/2.json", rows())
    got = drain(predictions.complete_cases(predictions.arriving(spark, str(tmp_path / "in"), files_per_trigger=1), 3), "cases_done", tmp_path)
    assert [(r["case_id"], r["steps"], round(r["case_score"], 9)) for r in got] == [("a", 3, 0.2)]


def test_windowed_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/1.json", rows())
    got = drain(predictions.windowed_counts(predictions.arriving(spark, str(tmp_path / "in")), "2 minutes"), "windows", tmp_path, "complete")
    assert sorted(r["steps"] for r in got) == [2, 3]
