"""Scored samples written as they arrive, a dump a batch, each exactly once.

A batch is written to the folder of its number, ``batch=N``, by replacing that folder.
Spark gives a batch that failed or was not acknowledged the same number and the same rows
again, so a rerun replaces what the first try left, and a batch whose manifest is
there already is not written anew.  The manifest (one small JSON file, made last and by a rename) says
that a dump is whole; readers go by manifests, so they never see half a dump.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    part, fs = _path(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    whole, _ = _path(spark, path)
    if not fs.rename(part, whole) and not fs.exists(whole):
        raise OSError(f"cannot publish {path}")


def write_dump(batch: DataFrame, batch_id: int, path: str) -> bool:
    """Write one dump; False where it is there already."""
    spark = batch.sparkSession
    manifest = f"{path}/_manifests/{batch_id}.json"
    where, fs = _path(spark, manifest)
    if fs.exists(where):
        return False
    target = f"{path}/batch={batch_id}"
    batch.write.mode("overwrite").parquet(target)
    rows = spark.read.schema(batch.schema).parquet(target).count()
    _write_text(spark, manifest, json.dumps({"batch": batch_id, "rows": rows}))
    return True


def dumps(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, after: Callable[[int], None] | None = None, **trigger) -> StreamingQuery:
    """Start writing ``stream`` to ``path`` (a batch size is the source's: files, rows or bytes a trigger).

    ``transform`` is applied to each batch (scores are computed there once), ``after`` is
    called when a dump is whole.  A restart with the same ``checkpoint`` goes on where the last one ended.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        made = batch if transform is None else transform(batch)
        write_dump(made, batch_id, path)
        if after is not None:
            after(batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_dumps(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of whole dumps, with ``batch``."""
    root, fs = _path(spark, f"{path}/_manifests")
    if not fs.exists(root):
        return spark.createDataFrame([], f"{schema}, batch bigint")
    whole = spark.read.option("pathGlobFilter", "*.json").schema("batch bigint, rows bigint").json(f"{path}/_manifests").select("batch")
    rows = spark.read.option("basePath", path).schema(f"{schema}, batch bigint").parquet(f"{path}/batch=*")
    return rows.join(whole, "batch", "left_semi")


def dump_problems(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(batch, rows, found): manifests whose dump has another number of rows."""
    stated = spark.read.option("pathGlobFilter", "*.json").schema("batch bigint, rows bigint").json(f"{path}/_manifests")
    found = read_dumps(spark, path, schema).groupBy("batch").agg(F.count("*").alias("found"))
    return stated.join(found, "batch", "left").withColumn("found", F.coalesce("found", F.lit(0))).filter("rows <> found")
