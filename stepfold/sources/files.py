"""Files written by tasks: copies under case folders, and encoded images held in tables.

Each task writes its own files through ``pyarrow.fs``, aside first and then renamed,
so a task that runs again writes the same bytes to the same place.  Stores that only
Hadoop's file systems reach are not covered.  The result is a report with a status for
each file; nothing is gathered on the driver.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .binary import image_format

_HASH = re.compile(r"[0-9a-fA-F]{64}")


def case_path(case_id: Column, stem: str, number: Column, source: Column) -> Column:
    """``cases/<case>/<stem>_<number><suffix>``; a source without a suffix gives ``.bin``."""
    suffix = F.lower(F.regexp_extract(source, r"[^/.](\.[^./]+)$", 1))
    return F.concat(F.lit("cases/"), case_id, F.lit(f"/{stem}_"), number.cast("string"), F.when(suffix == "", ".bin").otherwise(suffix))


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``alone``: whether no other row has the same key."""
    return rows.withColumn("alone", F.count("*").over(Window.partitionBy(key)) == 1)


def _put(where: fs.FileSystem, path: str, blocks: Iterator[bytes]) -> tuple[int, str]:
    """Bytes written and their SHA-256; nothing is left at ``path`` if reading fails."""
    where.create_dir(os.path.dirname(path), recursive=True)
    aside, size, digest = f"{path}.{uuid.uuid4().hex}", 0, hashlib.sha256()
    try:
        with where.open_output_stream(aside) as out:
            for b in blocks:
                out.write(b)
                digest.update(b)
                size += len(b)
        where.move(aside, path)
    except BaseException:
        if where.get_file_info(aside).type == fs.FileType.File:
            where.delete_file(aside)
        raise
    return size, digest.hexdigest()


def copy_files(pairs: DataFrame, link: bool = False) -> DataFrame:
    """(source, destination, bytes, sha256, status) of ``pairs`` (source, destination).

    Statuses: copied, linked (``link``, local stores only), missing, empty (a source of
    no bytes), suffix (source and destination differ in kind, which would need an
    encoder), repeated (two rows have one destination, none is written).
    """

    def one(source: str, destination: str, alone: bool) -> tuple[int | None, str | None, str]:
        if not alone:
            return None, None, "repeated"
        if os.path.splitext(source)[1].lower() != os.path.splitext(destination)[1].lower():
            return None, None, "suffix"
        (a, at), (b, to) = fs.FileSystem.from_uri(source), fs.FileSystem.from_uri(destination)
        info = a.get_file_info(at)
        if info.type != fs.FileType.File:
            return None, None, "missing"
        if info.size == 0:
            return 0, None, "empty"
        if link:
            b.create_dir(os.path.dirname(to), recursive=True)
            aside = f"{to}.{uuid.uuid4().hex}"
            os.symlink(at, aside)
            os.replace(aside, to)
            return info.size, None, "linked"
        with a.open_input_stream(at) as stream:
            size, digest = _put(b, to, iter(lambda: stream.read(1 << 20), b""))
        return size, digest, "copied"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = [one(*r) for r in part[["source", "destination", "alone"]].itertuples(index=False, name=None)]
            out = pd.DataFrame(done, columns=["bytes", "sha256", "status"]).astype({"bytes": "Int64"})
            yield pd.concat([part[["source", "destination"]].reset_index(drop=True), out], axis=1)

    return _numbered(pairs.select("source", "destination"), "destination").mapInPandas(run, "source string, destination string, bytes bigint, sha256 string, status string")


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """(stem, path, sha256, status) of encoded images (stem, content, expected) written as ``folder/stem.format``.

    ``expected`` is a SHA-256 or null.  Statuses: written, null (no image), lost (no
    image but a digest), format (of no known kind), digest (another one, or not a
    SHA-256), repeated (two rows have one stem, none is written).
    """

    def one(stem, content, expected, kind, alone):
        if not alone:
            return None, None, "repeated"
        if content is None:
            return None, None, "null" if expected is None else "lost"
        if kind is None:
            return None, None, "format"
        digest = hashlib.sha256(content).hexdigest()
        if expected is not None and (not _HASH.fullmatch(expected) or digest != expected.lower()):
            return None, digest, "digest"
        path = f"{folder}/{stem}.{'jpg' if kind == 'jpeg' else kind}"
        _put(*fs.FileSystem.from_uri(path), iter([content]))
        return path, digest, "written"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = [one(*(None if v is None or v is pd.NA else v for v in r)) for r in part[["stem", "content", "expected", "kind", "alone"]].itertuples(index=False, name=None)]
            yield pd.concat([part[["stem"]].reset_index(drop=True), pd.DataFrame(done, columns=["path", "sha256", "status"])], axis=1)

    rows = images.select("stem", "content", "expected", image_format(F.col("content")).alias("kind"))
    return _numbered(rows, "stem").mapInPandas(run, "stem string, path string, sha256 string, status string")
