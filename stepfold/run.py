"""Runs: settings with their precedence, stages that a resumed run takes over, documents beside them.

Nothing here touches rows: stages are DataFrames that are written once and read again.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterable, Mapping
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.sinks import _fs, write_document

T = TypeVar("T")


def settings(keys: Mapping[str, str], given: Mapping[str, Any] | None = None, environment: Mapping[str, str] | None = None, file: Mapping[str, Any] | None = None, defaults: Mapping[str, Any] | None = None, required: Iterable[str] = ()) -> dict[str, Any]:
    """The value of each key: what is given (neither null nor empty), else its environment variable, else the file's, else the default.

    ``keys`` maps keys to environment variables; a file may hold its values under ``evaluator``.
    """
    environment = os.environ if environment is None else environment
    values: Any = file or {}
    if not isinstance(values, Mapping):
        raise ValueError("settings must be a mapping")
    values = values.get("evaluator", values)
    if not isinstance(values, Mapping):
        raise ValueError("settings must be a mapping")
    out = {}
    for key, name in keys.items():
        own = (given or {}).get(key)
        out[key] = own if own not in (None, "") else environment.get(name, values.get(key, (defaults or {}).get(key)))
    lost = [k for k in required if out.get(k) in (None, "")]
    if lost:
        raise ValueError(f"missing settings: {', '.join(lost)}")
    return out


def read_settings(path: str) -> dict[str, Any]:
    """A settings file: JSON, or plain ``key: value`` lines, with one level of nesting by indentation."""
    with open(path, encoding="utf-8") as lines:
        text = lines.read()
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out: dict[str, Any] = {}
    inner: dict[str, Any] | None = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        key, colon, value = bare.strip().partition(":")
        if not colon:
            raise ValueError(f"{path}: not a setting: {line}")
        value = value.strip().strip("\"'")
        if bare[0] in " \t":
            if inner is None:
                raise ValueError(f"{path}: indented setting without a section: {line}")
            inner[key] = value
        elif value == "":
            inner = out[key] = {}
        else:
            out[key], inner = value, None
    return out


def first_existing(spark: SparkSession, places: Iterable[str], what: str = "file") -> str:
    """The first of the places that exists; an error names all of them."""
    places = list(dict.fromkeys(places))
    for place in places:
        path, fs = _fs(spark, place)
        if fs.exists(path):
            return place
    raise ValueError(f"{what} not found, looked at: {', '.join(places)}")


def label_bank_places(manifest: str, name: str, *roots: str) -> list[str]:
    """Where a label bank may lie: beside the manifest's folder, then under each root's data folder."""
    parent = manifest.rstrip("/").rsplit("/", 2)[0]
    return [f"{parent}/evaluator/{name}", *(f"{r.rstrip('/')}/data/evaluator/{name}" for r in roots)]


def with_retries(call: Callable[[], T], tries: int = 3, pause: float = 1.0, on: tuple[type[BaseException], ...] = (OSError, ValueError), sleep: Callable[[float], None] = time.sleep) -> T:
    """What ``call`` returns; after each failure but the last the wait grows by ``pause``."""
    for n in range(1, tries + 1):
        try:
            return call()
        except on:
            if n == tries:
                raise
            sleep(pause * n)
    raise AssertionError("tries must be positive")


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order: their number, and the sums and parities of two hashes of each.

    Nothing but three numbers is gathered, whatever the table's size.
    """
    cols = sorted(df.columns)
    text = F.to_json(F.struct(*(F.col(f"`{c}`") for c in cols)), {"ignoreNullFields": "false"})
    a, b = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    row = df.agg(F.count("*"), F.sum(a.cast("decimal(38,0)")), F.bit_xor(b)).first()
    return hashlib.sha256(json.dumps([cols, *map(str, row)]).encode()).hexdigest()


def inventory(files: DataFrame) -> DataFrame:
    """(path, sha256) of listed files (path, content), as a hash list of shipped sources holds them."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def inventory_problems(recorded: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem) of files that a hash list (path, sha256) lacks, that are gone or that changed."""
    j = recorded.select("path", F.col("sha256").alias("want")).join(inventory(files), "path", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("want") != F.col("sha256"), "changed")
    return j.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


class Run:
    """A folder of finished stages, which a resumed run reads instead of computing.

    The run's configuration, with the digests of its inputs, is written first; a
    resumed run must have the same.  A stage is written aside and renamed, so a stage
    that is there is whole.
    """

    def __init__(self, spark: SparkSession, folder: str, config: Mapping[str, Any], inputs: Mapping[str, DataFrame] | None = None, resume: bool = False):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.config = {**config, "inputs": {k: content_digest(v) for k, v in sorted((inputs or {}).items())}}
        text = json.dumps(self.config, sort_keys=True, indent=2, default=str) + "\n"
        old = self._read("run_config.json")
        if old is None:
            write_document(spark, text, f"{self.folder}/run_config.json")
        elif not resume:
            raise ValueError(f"output holds a run already: {folder}")
        elif json.loads(old) != json.loads(text):
            changed = sorted(k for k in {*json.loads(old), *json.loads(text)} if json.loads(old).get(k) != json.loads(text).get(k))
            raise ValueError(f"a resumed run must have the same configuration and inputs: {', '.join(changed)}")
        self.reused: list[str] = []

    def _read(self, name: str) -> str | None:
        path, fs = _fs(self.spark, f"{self.folder}/{name}")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's rows, from its files if it is finished."""
        path, fs = _fs(self.spark, f"{self.folder}/{name}")
        if fs.exists(path):
            self.reused.append(name)
        else:
            aside = f"{self.folder}/.{name}-{time.time_ns()}"
            make().write.parquet(aside)
            if not fs.rename(_fs(self.spark, aside)[0], path):
                raise OSError(f"cannot publish {path}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def report(self, **facts: Any) -> dict[str, Any]:
        """The run's manifest: its configuration, its stages and what is given; written as a document."""
        path, fs = _fs(self.spark, self.folder)
        stages = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and not s.getPath().getName().startswith("."))
        found = {"config": self.config, "stages": stages, "reused": list(self.reused), **facts}
        write_document(self.spark, json.dumps(found, sort_keys=True, indent=2, default=str) + "\n", f"{self.folder}/run_manifest.json")
        return found
