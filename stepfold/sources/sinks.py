"""Sinks: documents, staged tables, copies and a readable summary."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonl import write_lines

__all__ = ["write_lines", "write_document", "stage_and_swap", "write_once", "summary_lines", "frame_index"]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_document(spark: SparkSession, text: str, path: str) -> None:
    """One small text file, written aside and renamed."""
    p, fs = _fs(spark, path)
    aside, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(aside, p):
        raise OSError(f"cannot rename to {path}")


def stage_and_swap(df: DataFrame, path: str) -> None:
    """Replace a table: written aside first, the old one is put back if the swap fails."""
    spark = df.sparkSession
    token = uuid.uuid4().hex
    df.write.parquet(f"{path}.new-{token}")
    p, fs = _fs(spark, path)
    new, _ = _fs(spark, f"{path}.new-{token}")
    old, _ = _fs(spark, f"{path}.old-{token}")
    had = fs.exists(p)
    if had and not fs.rename(p, old):
        raise OSError(f"cannot set {path} aside")
    if not fs.rename(new, p):
        if had:
            fs.rename(old, p)
        raise OSError(f"cannot publish {path}")
    if had:
        fs.delete(old, True)


def write_once(df: DataFrame, path: str) -> None:
    """A table that must not be there yet."""
    df.write.mode("errorifexists").parquet(path)


def summary_lines(result: DataFrame, columns: list[str]) -> DataFrame:
    """(line) ``name: 0.1234`` of each column of a one-row result."""
    pairs = F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in columns))
    return result.select(F.explode(pairs).alias("x")).select(F.format_string("%s: %.4f", "x.k", "x.v").alias("line"))


def frame_index(frames: DataFrame, required: list[str]) -> DataFrame:
    """The frames with an asset id; columns must be there and references unique."""
    lost = [c for c in required if c not in frames.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    n = frames.groupBy("image_ref").count().filter("count > 1").limit(1).collect()
    if n:
        raise ValueError(f"repeated image_ref: {n[0]['image_ref']}")
    return frames.withColumn("asset_id", F.substring(F.sha2(F.col("image_ref").cast("binary"), 256), 1, 24))
