"""Binary and text scene sources: sensor streams, NumPy arrays, archives, camera text.

Files are listed and read by Spark's ``binaryFile`` source, so any store that Spark
reads will do; each file is parsed in one task.  Sensor streams may also be given by
path alone (``listed``): tasks then read them by ranges, so they may be of any size.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layout of version 4 of the sensor stream, little-endian.
SENSOR_VERSION = 4
SENSOR_CODECS, SENSOR_SHIFT = (2, 1), 1000.0
_HEAD, _MATRICES, _TAIL, _FRAME = struct.Struct("<IQ"), struct.Struct("<64f"), struct.Struct("<2i4IfQ"), struct.Struct("<16f4Q")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of files: their content is not read, so files of any size may be listed."""
    return files(spark, path, pattern).select("path", "length")


def read_sensor_stream(data: bytes | BinaryIO, wanted: set[int] | None = None) -> tuple[dict, Iterator[dict]]:
    """Header and frames; payloads only of the frames wanted, the others are stepped over.

    A stream that can seek is read as it goes, so a file need not be held.
    """
    source = io.BytesIO(data) if isinstance(data, bytes) else data
    size = source.seek(0, io.SEEK_END)
    source.seek(0)

    def take(n: int, what: str) -> bytes:
        if n > size - source.tell():
            raise ValueError(f"sensor stream ends in {what}")
        return source.read(n)

    version, length = _HEAD.unpack(take(_HEAD.size, "its header"))
    if version != SENSOR_VERSION:
        raise ValueError(f"sensor stream version {version}")
    take(length, "its name")
    m = _MATRICES.unpack(take(_MATRICES.size, "its header"))
    color_codec, depth_codec, cw, ch, dw, dh, shift, count = _TAIL.unpack(take(_TAIL.size, "its header"))
    names = ("intrinsic_color", "extrinsic_color", "intrinsic_depth", "extrinsic_depth")
    head = {n: list(m[16 * k : 16 * k + 16]) for k, n in enumerate(names)} | {"color_codec": color_codec, "depth_codec": depth_codec, "color_size": (cw, ch), "depth_size": (dw, dh), "depth_shift": shift, "frames": count}

    def frames(at: int) -> Iterator[dict]:
        for k in range(count):
            source.seek(at)
            *pose, t_color, t_depth, n_color, n_depth = _FRAME.unpack(take(_FRAME.size, f"frame {k}"))
            at += _FRAME.size
            if n_color + n_depth > size - at:
                raise ValueError(f"payload of frame {k} goes beyond the stream")
            row = {"frame": k, "pose": list(pose), "color_time": t_color, "depth_time": t_depth, "color": None, "depth": None}
            if wanted is not None and k in wanted:
                row |= {"color": source.read(n_color), "depth": source.read(n_depth)}
            yield row
            at += n_color + n_depth

    return head, frames(source.tell())


def check_sensor_header(head: dict, wanted: set[int] | None = None) -> None:
    """Errors of a header: kinds of payloads, depth unit, sizes, and frames that are not there."""
    if (head["color_codec"], head["depth_codec"]) != SENSOR_CODECS:
        raise ValueError(f"sensor stream of codecs {head['color_codec']} and {head['depth_codec']}")
    if head["depth_shift"] != SENSOR_SHIFT or min(*head["color_size"], *head["depth_size"]) <= 0:
        raise ValueError(f"sensor stream of depth unit {head['depth_shift']}, sizes {head['color_size']} and {head['depth_size']}")
    if wanted and not 0 <= min(wanted) <= max(wanted) < head["frames"]:
        raise ValueError(f"frames {min(wanted)} to {max(wanted)} are wanted of {head['frames']}")


def _source(path: str, content: bytes | None) -> bytes | BinaryIO:
    from .ranged import opened

    return opened(path) if content is None else content


def _with_content(streams: DataFrame) -> DataFrame:
    return streams.select("path", "content" if "content" in streams.columns else F.lit(None).cast("binary").alias("content"))


def inflate(data: bytes, expected: int) -> bytes:
    """zlib data that must give exactly ``expected`` bytes; never more are made."""
    d = zlib.decompressobj()
    out = d.decompress(data, expected + 1)
    if len(out) != expected or not d.eof:
        raise ValueError("depth payload has another size")
    return out


def sensor_poses(streams: DataFrame) -> DataFrame:
    """(path, frame, pose, valid) of each frame of sensor streams (path, and content where it is held already)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in part[["path", "content"]].itertuples(index=False, name=None):
                rows = [(path, r["frame"], r["pose"], bool(np.isfinite(r["pose"]).all())) for r in read_sensor_stream(_source(path, content))[1]]
                yield pd.DataFrame(rows, columns=["path", "frame", "pose", "valid"])

    return _with_content(streams).mapInPandas(run, "path string, frame int, pose array<double>, valid boolean")


def sensor_frames(streams: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, frame, pose, color, depth) of the frames in ``wanted`` (path, frame)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content, frames in part[["path", "content", "frames"]].itertuples(index=False, name=None):
                some = set(map(int, frames))
                head, rows = read_sensor_stream(_source(path, content), some)
                check_sensor_header(head, some)
                size = head["depth_size"][0] * head["depth_size"][1] * 2
                for r in rows:
                    if r["color"] is not None:
                        yield pd.DataFrame([(path, r["frame"], r["pose"], r["color"], inflate(r["depth"], size))], columns=["path", "frame", "pose", "color", "depth"])

    lists = wanted.groupBy("path").agg(F.collect_set("frame").alias("frames"))
    return _with_content(streams).join(lists, "path").mapInPandas(run, "path string, frame int, pose array<double>, color binary, depth binary")


def arrays(npy: DataFrame) -> DataFrame:
    """(path, shape, values) of two-dimensional ``.npy`` files; pickled objects are refused."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in part[["path", "content"]].itertuples(index=False, name=None):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.ndim != 2:
                    raise ValueError(f"{path}: {a.ndim} dimensions")
                yield pd.DataFrame([(path, list(a.shape), a.astype(np.float32).ravel())], columns=["path", "shape", "values"])

    return npy.select("path", "content").mapInPandas(run, "path string, shape array<int>, values array<float>")


def archive_members(archives: DataFrame, names: list[str] | None = None, cap: int = 128 << 20) -> DataFrame:
    """(path, member, size, crc, content) of archive members; repeated names and members over ``cap`` are errors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in part[["path", "content"]].itertuples(index=False, name=None):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    infos = [i for i in z.infolist() if not i.is_dir() and (names is None or i.filename in names)]
                    if len({i.filename for i in infos}) < len(infos):
                        raise ValueError(f"{path}: repeated member")
                    for i in infos:
                        if i.file_size > cap:
                            raise ValueError(f"{path}: {i.filename} has {i.file_size} bytes")
                        yield pd.DataFrame([(path, i.filename, i.file_size, i.CRC, z.read(i))], columns=["path", "member", "size", "crc", "content"])

    return archives.select("path", "content").mapInPandas(run, "path string, member string, size bigint, crc bigint, content binary")


def image_format(content: Column) -> Column:
    """The format of encoded images by their first bytes; null for others."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")


def image_columns(df: DataFrame) -> list[str]:
    """Binary columns, and structs of bytes and path: what may hold encoded images."""
    kinds = dict(df.dtypes)
    return [c for c, k in kinds.items() if k == "binary" or (k.startswith("struct<") and "bytes:binary" in k)]


def preferred_split(names: list[str]) -> str:
    """test, train or validation in this order, else the first."""
    return next((s for s in ("test", "train", "validation") if s in names), names[0])


def key_values(lines: DataFrame, key: str, count: int, file: str = "path") -> DataFrame:
    """(path, values) of ``key = v1 v2 ...`` in text files; valid where the key occurs once with ``count`` numbers."""
    pair = F.split(F.col("value"), r"\s*=\s*", 2)
    found = lines.filter(F.trim(pair[0]) == key).select(file, F.split(F.trim(F.get(pair, F.lit(1))), r"\s+").alias("v"))
    numbers = F.transform("v", lambda x: x.try_cast("double"))
    one = found.groupBy(file).agg(F.count("*").alias("n"), F.first(numbers).alias("values"))
    good = (F.col("n") == 1) & (F.size("values") == count) & F.forall("values", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return one.select(file, "values", F.coalesce(good, F.lit(False)).alias("valid"))


def text_round_trip(x: Column) -> Column:
    """What a number becomes through six decimals of text and single precision."""
    return F.format_string("%f", x.cast("double")).cast("float")


def fisheye_frames(transforms: DataFrame) -> DataFrame:
    """(path, name, matrix, fl_x, fl_y, cx, cy, w, h, test) of transforms documents (path, text), test frames too."""
    frame = "struct<file_path:string,transform_matrix:array<array<double>>>"
    kind = f"struct<w:int,h:int,fl_x:double,fl_y:double,cx:double,cy:double,frames:array<{frame}>,test_frames:array<{frame}>>"
    doc = transforms.select("path", F.from_json("text", kind).alias("d"))

    def marked(c, test):
        return F.transform(F.coalesce(F.col(c), F.array().cast(f"array<{frame}>")), lambda f: F.struct(f["file_path"].alias("name"), f["transform_matrix"].alias("matrix"), F.lit(test).alias("test")))

    rows = doc.select("path", "d.w", "d.h", "d.fl_x", "d.fl_y", "d.cx", "d.cy", F.explode(F.concat(marked("d.frames", False), marked("d.test_frames", True))).alias("f"))
    return rows.select("path", "f.name", "f.matrix", "fl_x", "fl_y", "cx", "cy", "w", "h", "f.test")
