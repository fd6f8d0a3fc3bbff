import struct

import pytest
from pyspark.sql import functions as F

from test_sources import stream

from stepfold.sources.sensor import Frames, PushingSensorReader, SensorReader, SensorStreams, frames


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("streams")
    (where / "b").mkdir()
    (where / "a.sens").write_bytes(stream([[float(k)] * 16 for k in range(10)]))
    (where / "b" / "c.sens").write_bytes(stream([[float(-k)] * 16 for k in range(3)], b"payload"))
    (where / "b" / "none.sens").write_bytes(stream([]))
    (where / "b" / "other.txt").write_bytes(b"x")
    spark.dataSource.register(SensorStreams)
    return where


def load(spark, folder, **options):
    return spark.read.format("sensor_stream").options(path=str(folder), **options).load()


def test_frames_and_partitions(spark, folder):
    df = load(spark, folder, framesPerTask="4", payload="true")
    assert df.columns == ["path", "frame", "pose", "color_time", "depth_time", "color", "depth"]
    assert df.rdd.getNumPartitions() == 4  # three of the first stream, one of the second
    rows = {(r["path"].rpartition("/")[2], r["frame"]): r for r in df.collect()}
    assert len(rows) == 13 and rows["a.sens", 7]["pose"] == [7.0] * 16 and bytes(rows["c.sens", 2]["color"]) == b"payload"
    assert struct.unpack("<4H", bytes(rows["a.sens", 9]["depth"])) == (1, 2, 3, 4) and rows["a.sens", 4]["depth_time"] == 5
    assert load(spark, folder).filter("color IS NOT NULL OR depth IS NOT NULL").count() == 0
    assert load(spark, folder / "a.sens").count() == 10 and load(spark, folder / "b" / "none.sens").count() == 0


def test_filters_leave_out_partitions(spark, folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, Not

    def planned(*filters):
        reader = PushingSensorReader({"path": str(folder), "framesPerTask": "4"})
        left = list(reader.pushFilters(list(filters)))
        return left, [(p.path.rpartition("/")[2], p.low, p.high, p.only) for p in reader.partitions()]

    assert planned(GreaterThan(("frame",), 5), LessThanOrEqual(("frame",), 8)) == ([], [("a.sens", 6, 8, None), ("a.sens", 8, 9, None)])
    assert planned(In(("frame",), (1, 9, 77))) == ([], [("a.sens", 0, 4, (1,)), ("a.sens", 8, 10, (9,)), ("c.sens", 0, 3, (1,))])
    assert planned(EqualTo(("path",), f"{folder}/b/c.sens"), EqualTo(("frame",), 0))[1] == [("c.sens", 0, 3, (0,))]
    other = Not(EqualTo(("frame",), 1))
    assert planned(other)[0] == [other] and planned(EqualTo(("frame",), 99))[1] == []


def test_same_rows_with_and_without_pushed_filters(spark, folder):
    want = [("a.sens", 6), ("a.sens", 7)]
    for on in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", on)
        try:
            got = frames(spark, str(folder), True, 4).filter("frame > 5 AND frame IN (1, 6, 7)").select(F.substring_index("path", "/", -1), "frame")
            assert sorted(map(tuple, got.collect())) == want
            assert frames(spark, str(folder)).filter("frame = 99").count() == 0
        finally:
            spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_only_wanted_payloads_are_read(folder):
    reader = SensorReader({"path": str(folder), "payload": "true"})
    batches = list(reader.read(Frames(f"{folder}/a.sens", 2, 6, (3, 5))))
    assert [x for b in batches for x in b.column("frame").to_pylist()] == [3, 5]
    assert all(x is not None for b in batches for x in b.column("color").to_pylist())


def test_errors(folder, tmp_path):
    (tmp_path / "cut.sens").write_bytes(stream([[0.0] * 16] * 3)[:-2])
    with pytest.raises(ValueError):
        list(SensorReader({"path": str(tmp_path), "payload": "true"}).read(Frames(str(tmp_path / "cut.sens"), 0, 3)))
    with pytest.raises(ValueError):
        SensorReader({})
    with pytest.raises(ValueError):
        SensorReader({"path": "x", "framesPerTask": "0"})
