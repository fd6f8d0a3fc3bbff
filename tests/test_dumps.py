import json

import pytest
from pyspark.sql import functions as F

from stepfold.streaming import dumps as d

SCHEMA = "case_id string, score double"


def arriving(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(path)


@pytest.fixture
def incoming(tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"case_id": f"c{k}-{i}", "score": i / 10}) + "\n" for i in range(5)))
    return tmp_path


def scored(batch):
    return batch.withColumn("score", F.col("score") * 2)


def run(spark, at, after=None):
    q = d.dumps(arriving(spark, str(at / "in")), str(at / "out"), str(at / "cp"), scored, after)
    q.awaitTermination(120)
    return q


def whole(spark, at):
    return sorted((r["case_id"], r["score"]) for r in d.read_dumps(spark, str(at / "out"), SCHEMA).collect())


WANT = sorted((f"c{k}-{i}", i / 10 * 2) for k in range(4) for i in range(5))


def test_each_batch_is_one_dump(spark, incoming):
    run(spark, incoming)
    assert whole(spark, incoming) == WANT
    assert d.read_dumps(spark, str(incoming / "out"), SCHEMA).select("batch").distinct().count() == 4
    assert d.dump_problems(spark, str(incoming / "out"), SCHEMA).count() == 0


@pytest.mark.parametrize("where", [0, 2])
def test_a_failure_between_dumps_writes_nothing_twice(spark, incoming, where):
    """The dump is whole but the batch isn't acknowledged: Spark gives it again."""

    def fail(batch_id):
        if batch_id == where:
            raise RuntimeError("killed between batches")

    with pytest.raises(Exception, match="killed"):
        run(spark, incoming, fail)
    stamp = (incoming / "out" / "_manifests" / f"{where}.json").stat().st_mtime_ns
    assert len(whole(spark, incoming)) == 5 * (where + 1)
    run(spark, incoming)
    assert whole(spark, incoming) == WANT
    assert (incoming / "out" / "_manifests" / f"{where}.json").stat().st_mtime_ns == stamp


def test_a_failure_within_a_dump_is_replaced(spark, incoming, monkeypatch):
    """Rows were written but no manifest: they are not read, and the rerun replaces them."""
    real = d._write_text
    monkeypatch.setattr(d, "_write_text", lambda *a: (_ for _ in ()).throw(RuntimeError("killed within a dump")))
    with pytest.raises(Exception, match="killed"):
        run(spark, incoming)
    assert whole(spark, incoming) == []
    monkeypatch.setattr(d, "_write_text", real)
    run(spark, incoming)
    assert whole(spark, incoming) == WANT
    assert not d.write_dump(spark.createDataFrame([("x", 1.0)], SCHEMA), 0, str(incoming / "out"))
    assert whole(spark, incoming) == WANT
