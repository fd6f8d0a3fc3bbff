"""Seekable reading by byte ranges: remote archives and sensor streams of any size, with a bounded buffer."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 128 << 20


class Cancelled(Exception):
    """Reading was given up."""


class RangeFile(io.RawIOBase):
    """A read-only file over ``read(start, end)``, which gives the bytes [start, end).

    At least ``ahead`` bytes are asked for at a time and kept; a request of over
    ``most`` bytes is an error.  ``cancelled`` is asked before each request.
    """

    def __init__(self, read: Callable[[int, int], bytes], size: int, ahead: int = 64 << 10, most: int = MOST, cancelled: Callable[[], bool] | None = None):
        self._read, self.size, self._ahead, self._most, self._cancelled = read, size, ahead, most, cancelled
        self._at, self._start, self._held = 0, 0, b""

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> int:
        at = offset + {os.SEEK_SET: 0, os.SEEK_CUR: self._at, os.SEEK_END: self.size}[whence]
        if at < 0:
            raise ValueError("seek before the start")
        self._at = at
        return at

    def read(self, size: int | None = -1) -> bytes:
        if self._cancelled is not None and self._cancelled():
            raise Cancelled
        left = max(0, self.size - self._at)
        n = left if size is None or size < 0 else min(size, left)
        if n > self._most:
            raise ValueError(f"a request of {n} bytes")
        if n == 0:
            return b""
        skip = self._at - self._start
        if not 0 <= skip <= len(self._held) - n:
            end = min(self.size, self._at + max(n, self._ahead))
            self._held, self._start, skip = self._read(self._at, end), self._at, 0
            if len(self._held) != end - self._start:
                raise OSError("the source gave another number of bytes than asked for")
        self._at += n
        return self._held[skip : skip + n]


def opened(uri: str, cancelled: Callable[[], bool] | None = None) -> RangeFile:
    """A file of any store that ``pyarrow.fs`` knows, by its address."""
    where, path = fs.FileSystem.from_uri(uri)
    source = where.open_input_file(path)

    def read(start: int, end: int) -> bytes:
        source.seek(start)
        return source.read(end - start)

    return RangeFile(read, source.size(), cancelled=cancelled)


def members(archive: io.RawIOBase, names: set[str] | None = None, cap: int = MOST) -> Iterator[tuple[str, int, int, bytes]]:
    """(name, size, crc, content) of an archive's members; only the wanted ones are read."""
    with zipfile.ZipFile(archive) as z:
        infos = [i for i in z.infolist() if not i.is_dir() and (names is None or i.filename.removeprefix("./") in names)]
        if len({i.filename.removeprefix("./") for i in infos}) < len(infos):
            raise ValueError("repeated member")
        for i in infos:
            if i.file_size > cap:
                raise ValueError(f"{i.filename} has {i.file_size} bytes")
            yield i.filename.removeprefix("./"), i.file_size, i.CRC, z.read(i)


def archive_members(wanted: DataFrame, cap: int = MOST) -> DataFrame:
    """(path, member, size, crc, content) of the wanted members (path, member) of archives, read by ranges.

    An archive is one task's work; an archive that lacks a wanted member fails its task,
    and Spark ends a cancelled job group's tasks.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, names in part[["path", "members"]].itertuples(index=False, name=None):
                left = set(names)
                with opened(path) as archive:
                    for name, size, crc, content in members(archive, set(names), cap):
                        left.discard(name)
                        yield pd.DataFrame([(path, name, size, crc, content)], columns=["path", "member", "size", "crc", "content"])
                if left:
                    raise ValueError(f"{path}: no member {', '.join(sorted(left))}")

    lists = wanted.groupBy("path").agg(F.collect_set("member").alias("members"))
    return lists.mapInPandas(run, "path string, member string, size bigint, crc bigint, content binary")
