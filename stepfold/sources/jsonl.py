"""JSON Lines: scan with line numbers and quarantine, canonical lines and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def canonical_line(columns: list[str]) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, line) of all lines.

    Lines of a file get an ordinal that follows their order: the position within the
    split and the splits' order.  Lines are numbered within their split, which no task
    sorts more than one of; splits add up what lies before them.  Blank lines count, as
    messages name physical lines.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    lines = lines.withColumn("place", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(sizes, ["file", "block"]).select("file", (F.col("before") + F.col("place")).alias("row_no"), "line")


def parse_lines(lines: DataFrame, schema: StructType | str, text: str = "line") -> tuple[DataFrame, DataFrame]:
    """Good rows (other columns and the schema's fields), and lines that are not objects of that shape.

    Blank lines are neither.  JSON true is not a number: fields keep their types.
    """
    keep = [c for c in lines.columns if c != text]
    lines = lines.filter(F.trim(text) != "")
    kind = F.when(F.trim(text).startswith("{"), F.from_json(text, schema, {"mode": "PERMISSIVE"}))
    whole = F.try_parse_json(text).isNotNull() & F.trim(text).startswith("{")
    parsed = lines.withColumn("_row", kind).withColumn("_ok", F.coalesce(whole, F.lit(False)))
    return parsed.filter("_ok").select(*keep, "_row.*"), parsed.filter("NOT _ok").select(*keep, text)


def write_lines(df: DataFrame, path: str, order: str, columns: list[str] | None = None) -> None:
    """Canonical lines, globally in ``order``; part files follow each other in that order."""
    columns = columns or [c for c in df.columns if c != order]
    df.repartitionByRange(order).sortWithinPartitions(order).select(canonical_line(columns).alias("value")).write.mode("errorifexists").text(path)
