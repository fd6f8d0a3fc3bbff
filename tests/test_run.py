import io
import json
import threading
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from stepfold import run
from stepfold.operators import delivery
from stepfold.sources import backends, binary, ranged
from test_sources import stream

KEYS = {"model": "X_MODEL", "device": "X_DEVICE", "url": "X_URL"}


def test_precedence_of_settings(tmp_path):
    file = tmp_path / "own.yaml"
    file.write_text("# comment\nevaluator:\n  model: from-file\n  device: \"file:0\"\n")
    values = run.read_settings(str(file))
    assert run.settings(KEYS, {"model": "given"}, {"X_MODEL": "env", "X_DEVICE": "env:1"}, values, {"url": "d"}) == {"model": "given", "device": "env:1", "url": "d"}
    assert run.settings(KEYS, {"model": ""}, {}, values, {"device": "cpu"}) == {"model": "from-file", "device": "file:0", "url": None}
    (tmp_path / "own.json").write_text('{"model": "flat"}')
    assert run.settings(KEYS, None, {}, run.read_settings(str(tmp_path / "own.json")))["model"] == "flat"
    with pytest.raises(ValueError, match="url"):
        run.settings(KEYS, None, {}, values, required=("model", "url"))
    with pytest.raises(ValueError, match="mapping"):
        run.settings(KEYS, None, {}, {"evaluator": [1]})


def test_first_place_that_exists(spark, tmp_path):
    (tmp_path / "data/evaluator").mkdir(parents=True)
    (tmp_path / "data/evaluator/bank.jsonl").write_text("{}")
    places = run.label_bank_places(f"{tmp_path}/hf/test/manifest.jsonl", "bank.jsonl", str(tmp_path / "none"), str(tmp_path))
    assert places[0] == f"{tmp_path}/hf/evaluator/bank.jsonl"
    assert run.first_existing(spark, places) == f"{tmp_path}/data/evaluator/bank.jsonl"
    with pytest.raises(ValueError, match="label bank not found.*none"):
        run.first_existing(spark, places[:2], "label bank")


def test_retries():
    waits, calls = [], iter([OSError("a"), ValueError("b"), 7])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert run.with_retries(call, 3, 2.0, sleep=waits.append) == 7 and waits == [2.0, 4.0]
    with pytest.raises(KeyError):
        run.with_retries(lambda: {}["x"], 3, sleep=waits.append)
    with pytest.raises(OSError):
        run.with_retries(lambda: (_ for _ in ()).throw(OSError("x")), 2, sleep=waits.append)


def test_resumed_runs(spark, tmp_path):
    folder, rows, made = str(tmp_path / "out"), spark.range(5).toDF("n"), []

    def stage():
        made.append(1)
        return rows.withColumn("m", F.col("n") * 2)

    one = run.Run(spark, folder, {"model": "a"}, {"rows": rows})
    assert one.stage("raw", stage).count() == 5 and one.report(steps=5)["stages"] == ["raw"]
    with pytest.raises(ValueError, match="already"):
        run.Run(spark, folder, {"model": "a"}, {"rows": rows})
    # the same rows in another order and layout are the same input
    two = run.Run(spark, folder, {"model": "a"}, {"rows": rows.orderBy(F.desc("n")).repartition(3)}, resume=True)
    assert two.stage("raw", stage).agg(F.sum("m")).first()[0] == 20 and two.reused == ["raw"] and made == [1]
    two.stage("folded", lambda: rows.agg(F.sum("n").alias("s")))
    assert json.loads((tmp_path / "out/run_config.json").read_text())["model"] == "a" and two.report()["stages"] == ["folded", "raw"]
    for config, data in (({"model": "b"}, rows), ({"model": "a"}, rows.filter("n < 4")), ({"model": "a"}, rows.union(rows.limit(1)))):
        with pytest.raises(ValueError, match="same configuration"):
            run.Run(spark, folder, config, {"rows": data}, resume=True)


def test_inventories(spark, tmp_path):
    for name, text in (("a.py", "one"), ("b.py", "two"), ("c.py", "three")):
        (tmp_path / name).write_text(text)
    recorded = spark.createDataFrame(run.inventory(binary.files(spark, str(tmp_path), "*.py")).collect())
    assert run.inventory_problems(recorded, binary.files(spark, str(tmp_path), "*.py")).count() == 0
    (tmp_path / "a.py").write_text("other")
    (tmp_path / "b.py").unlink()
    (tmp_path / "d.py").write_text("new")
    got = {(r["path"].rsplit("/", 1)[1], r["problem"]) for r in run.inventory_problems(recorded, binary.files(spark, str(tmp_path), "*.py")).collect()}
    assert got == {("a.py", "changed"), ("b.py", "missing"), ("d.py", "unlisted")}


def test_backends(spark):
    pairs = spark.createDataFrame([(1, 0, 0), (1, 1, 2)], "step_id bigint, gt_idx int, pred_idx int")
    answers = spark.createDataFrame([(1, 1, 2, True, 0.9)], "step_id bigint, gt_idx int, pred_idx int, same boolean, confidence double")
    assert backends.names("verdicts") == ["dry_run", "table"]
    assert [r["note"] for r in backends.table("verdicts", "dry_run", pairs).collect()] == ["dry_run"] * 2
    assert {(r["gt_idx"], r["same"], r["note"]) for r in backends.table("verdicts", "table", pairs, answers).collect()} == {(0, None, "unanswered"), (1, True, None)}
    with pytest.raises(ValueError, match="known: dry_run, table"):
        backends.table("verdicts", "other", pairs)

    @backends.register("poses", "still")
    def still(steps):
        return steps.withColumn("yaw", F.lit(0.0))

    assert backends.table("poses", "still", spark.range(2)).columns == ["id", "yaw"] and "still" in backends.names("poses")
    with pytest.raises(ValueError, match="already"):
        backends.register("poses", "still")(still)
    assert backends.loader("json", "loads")("[1]") == [1]
    with pytest.raises(ValueError, match="not installed"):
        backends.loader("no_such_module_here")


def test_range_files():
    data, asked = bytes(range(256)) * 40, []

    def read(start, end):
        asked.append((start, end))
        return data[start:end]

    f = ranged.RangeFile(read, len(data), ahead=100)
    assert f.read(10) == data[:10] and f.read(20) == data[10:30] and asked == [(0, 100)]
    f.seek(-5, io.SEEK_END)
    assert f.read() == data[-5:] and f.read() == b"" and f.tell() == len(data)
    with pytest.raises(ValueError):
        f.seek(-1)
    with pytest.raises(ValueError, match="bytes"):
        ranged.RangeFile(read, len(data), most=50).read()
    with pytest.raises(OSError):
        ranged.RangeFile(lambda a, b: b"x", 50).read(10)
    stop = threading.Event()
    g = ranged.RangeFile(read, len(data), cancelled=stop.is_set)
    g.read(1)
    stop.set()
    with pytest.raises(ranged.Cancelled):
        g.read(1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(50):
            z.writestr(f"s/{k}.txt", bytes([k]) * 10_000)
    blob, asked = out.getvalue(), []
    remote = ranged.RangeFile(lambda a, b: asked.append(b - a) or blob[a:b], len(blob), ahead=256)
    assert [(n, s, c) for n, s, _, c in ranged.members(remote, {"s/7.txt"})] == [("s/7.txt", 10_000, b"\x07" * 10_000)]
    assert sum(asked) < len(blob)
    with pytest.raises(ValueError, match="bytes"):
        list(ranged.members(ranged.RangeFile(lambda a, b: blob[a:b], len(blob)), cap=100))


def test_files_read_by_ranges_in_tasks(spark, tmp_path):
    good = list(range(16))
    (tmp_path / "a.sens").write_bytes(stream([good, good, good]))
    (tmp_path / "bad.sens").write_bytes(stream([good])[:-2])
    some = binary.listed(spark, str(tmp_path), "a.sens")
    assert some.columns == ["path", "length"]
    assert [r["frame"] for r in binary.sensor_poses(some).orderBy("frame").collect()] == [0, 1, 2]
    wanted = some.select("path", F.lit(2).alias("frame"))
    assert [r["frame"] for r in binary.sensor_frames(some, wanted).collect()] == [2]
    with pytest.raises(Exception, match="wanted of 3"):
        binary.sensor_frames(some, some.select("path", F.lit(3).alias("frame"))).collect()
    with pytest.raises(Exception, match="beyond the stream"):
        binary.sensor_poses(binary.listed(spark, str(tmp_path), "bad.sens")).collect()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("./a.txt", "alpha")
        z.writestr("b.txt", "beta")
    path = str(tmp_path / "z.zip")
    rows = ranged.archive_members(spark.createDataFrame([(f"file://{path}", "a.txt")], "path string, member string")).collect()
    assert [(r["member"], bytes(r["content"]), r["crc"]) for r in rows] == [("a.txt", b"alpha", zlib.crc32(b"alpha"))]
    with pytest.raises(Exception, match="no member c.txt"):
        ranged.archive_members(spark.createDataFrame([(f"file://{path}", "c.txt")], "path string, member string")).collect()


def test_headers_of_other_streams():
    head, _ = binary.read_sensor_stream(stream([list(range(16))]))
    binary.check_sensor_header(head, {0})
    for change in ({"color_codec": 1}, {"depth_shift": 500.0}, {"depth_size": (0, 2)}):
        with pytest.raises(ValueError):
            binary.check_sensor_header(head | change, {0})


def test_lines_are_numbered_across_splits(spark, tmp_path):
    from stepfold.sources import jsonl

    (tmp_path / "long.jsonl").write_text("".join(f'{{"k": {k}}}\n' for k in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = jsonl.numbered_lines(spark, str(tmp_path / "long.jsonl")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["row_no"], r["line"]) for r in rows) == [(k + 1, f'{{"k": {k}}}') for k in range(20_000)]


def test_alternatives_count_once(spark):
    plan = spark.createDataFrame([("d", "a", ["a", "b"]), ("d", "c", None)], "dataset string, path string, alternatives array<string>")
    none = spark.createDataFrame([], "path string")
    both = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    assert {(r["path"], r["status"]) for r in delivery.unpack_report(plan, none, both).collect()} == {("a", "unverified"), ("c", "missing")}
    assert delivery.delivery_summary(delivery.unpack_report(plan, both, none)).first().asDict() == {"dataset": "d", "status": "missing-inputs", "files": 2, "missing": 1, "unverified": 0}
