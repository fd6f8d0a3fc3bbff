"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word definition here, as a character-class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names.  Only where that is unset and the master
    is local (driver and executors are one process) a temporary folder is made; a
    cluster without the setting is an error.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        where = sc.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="stepfold-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_files(spark: SparkSession, path: str) -> None:
    """Delete what was written to ``path``, through Spark's own file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A key is hot where it has more than this share of the rows (so there are fewer than 4,096 hot keys) and more rows than ``HOT_LEAST``.
HOT_SHARE, HOT_LEAST = 1 / 4096, 1000
SALTS = 64


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: float) -> DataFrame | None:
    """The hot keys of a table of keys with their numbers of rows (computed already); None where there are none."""
    hot = counts.filter(F.col(n) > max(total * HOT_SHARE, HOT_LEAST)).select(*keys)
    return None if hot.isEmpty() else hot


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None, by: list[str | Column], how: str = "inner") -> DataFrame:
    """Join many rows with a table that holds each key once; rows of ``hot`` keys are dealt to ``SALTS`` tasks.

    ``by`` tells rows of a key apart; the table's row of a hot key goes to each of the
    tasks.  There are fewer than 1 / ``HOT_SHARE`` hot keys, hence the broadcasts.  The
    join is an equi-join on ``keys``; a null key has no partner.
    """
    if hot is None:
        return rows.join(table, keys, how)
    mark = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    dealt = rows.join(mark, keys, "left").withColumn("__salt", salt).drop("__hot")
    wide = table.join(mark, keys, "left").withColumn("__salt", salts).drop("__hot")
    return dealt.join(wide, [*keys, "__salt"], how).drop("__salt")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: float, by: list[str | Column], how: str = "inner") -> DataFrame:
    """``salted_join`` with a computed table whose column ``n`` (dropped) is the number of rows of a key, ``total`` at least their sum."""
    return salted_join(rows, table.drop(n), keys, hot_keys(table, keys, n, total), by, how)


def word_blocks(data: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of ``data`` (split at ``[\\x20\\x09-\\x0D]``), a bounded block at a time.

    ``bytes.split()`` splits at exactly those six bytes.  Blocks are cut at white
    space, so no word is divided; a word longer than ``size`` stays whole.
    """
    if len(data) <= size:
        yield data.split()
        return
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + size)
        while end < n and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[start:end].split()
        start = end
