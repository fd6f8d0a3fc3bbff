"""Sensor streams as a Python data source: frames are rows, one stream is read by several tasks.

    frames(spark, uri, payload=True)

``path`` is a stream or a folder of ``*.sens`` streams, by an address or path that
``pyarrow.fs`` knows.  A partition is a run of ``framesPerTask`` frames (256) of one stream.
Planning reads each stream's header; comparisons of ``frame`` and ``path`` with constants
leave out partitions, and frames within them, where Spark pushes filters to Python sources
(``spark.sql.python.filterPushdown.enabled`` and the option ``pushdown``, which :func:`frames` sets); without it Spark filters the rows itself.  Payloads are read only with
``payload`` and only of frames that stay; the others are stepped over by their sizes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .binary import check_sensor_header, inflate, read_sensor_stream
from .ranged import opened

SCHEMA = "path string, frame int, pose array<double>, color_time bigint, depth_time bigint, color binary, depth binary"
_ARROW = pa.schema([("path", pa.string()), ("frame", pa.int32()), ("pose", pa.list_(pa.float64())), ("color_time", pa.int64()), ("depth_time", pa.int64()), ("color", pa.binary()), ("depth", pa.binary())])
#: Bytes of payloads that a batch of rows holds at most, but for one frame.
BATCH_BYTES = 16 << 20


@dataclass
class Frames(InputPartition):
    """The frames from ``low`` up to ``high`` of a stream; ``only`` some of them, if given."""

    path: str
    low: int
    high: int
    only: tuple[int, ...] | None = None


class SensorStreams(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sensor_stream"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SensorReader:
        # Spark refuses readers with pushed filters where its setting is off
        pushed = self.options.get("pushdown", "false").lower() == "true"
        return (PushingSensorReader if pushed else SensorReader)(dict(self.options))


class SensorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path, self.payload = options["path"], options.get("payload", "false").lower() == "true"
        self.per_task = int(options.get("framespertask", options.get("framesPerTask", "256")))
        if self.per_task < 1:
            raise ValueError("framesPerTask must be positive")
        self.low, self.high = 0, 1 << 62
        self.only: set[int] | None = None
        self.paths: set[str] | None = None

    def _streams(self) -> list[str]:
        where, path = fs.FileSystem.from_uri(self.path if "://" in self.path else PurePosixPath(self.path).as_posix())
        info = where.get_file_info(path)
        if info.type == fs.FileType.File:
            return [self.path]
        root = self.path.rstrip("/")
        found = where.get_file_info(fs.FileSelector(path, recursive=True))
        return sorted(root + f.path.removeprefix(path.rstrip("/")) for f in found if f.type == fs.FileType.File and f.path.endswith(".sens"))

    def partitions(self) -> list[Frames]:
        out = []
        for path in self._streams():
            if self.paths is not None and path not in self.paths:
                continue
            with opened(path) as source:
                head, _ = read_sensor_stream(source)
            check_sensor_header(head)
            count = head["frames"]
            for low in range(0, count, self.per_task):
                a, b = max(low, self.low), min(low + self.per_task, count, self.high)
                only = None if self.only is None else tuple(sorted(k for k in self.only if a <= k < b))
                if a < b and only != ():
                    out.append(Frames(path, a, b, only))
        return out

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was left to read
            return
        low, high = partition.low, partition.high
        wanted = set(range(low, high)) if partition.only is None else set(partition.only)
        with opened(partition.path) as source:
            head, frames = read_sensor_stream(source, wanted if self.payload else None)
            size = head["depth_size"][0] * head["depth_size"][1] * 2
            held, n = [], 0
            for r in frames:
                if r["frame"] in wanted:
                    depth = None if r["depth"] is None else inflate(r["depth"], size)
                    held.append((partition.path, r["frame"], r["pose"], r["color_time"], r["depth_time"], r["color"], depth))
                    n += len(r["color"] or b"") + len(depth or b"") + 256
                if held and (n >= BATCH_BYTES or r["frame"] + 1 >= high):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    held, n = [], 0
                if r["frame"] + 1 >= high:
                    return


class PushingSensorReader(SensorReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds and sets of frames, and sets of paths; what is not understood goes back to Spark."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("frame",) and isinstance(f, (EqualTo, In)):
                values = {value} if isinstance(f, EqualTo) else set(value)
                self.only = values if self.only is None else self.only & values
            elif column == ("path",) and isinstance(f, (EqualTo, In)):
                values = {value} if isinstance(f, EqualTo) else set(value)
                self.paths = values if self.paths is None else self.paths & values
            elif column == ("frame",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif column == ("frame",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, value + isinstance(f, LessThanOrEqual))
            else:
                yield f


def frames(spark: SparkSession, path: str, payload: bool = False, per_task: int = 256) -> DataFrame:
    """The frames of a stream or folder of streams; filters are pushed where the session allows it."""
    spark.dataSource.register(SensorStreams)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("sensor_stream").options(path=path, payload=str(payload).lower(), framesPerTask=str(per_task), pushdown=pushed).load()
