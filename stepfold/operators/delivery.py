"""Delivered sources and built indexes: unpack reports, verification against references, rebuilt manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpack_report(plan: DataFrame, verified: DataFrame, existing: DataFrame) -> DataFrame:
    """(dataset, path, status) of each planned file (dataset, path, alternatives).

    A file is ``verified`` where it or an alternative is among the ``verified`` ones
    (path), ``unverified`` where one only exists (``existing``: path), else ``missing``.
    """
    each = plan.select("dataset", "path", F.explode(F.array_distinct(F.concat(F.array("path"), F.coalesce("alternatives", F.array().cast("array<string>"))))).alias("p"))
    good = verified.select(F.col("path").alias("p")).distinct().withColumn("good", F.lit(True))
    there = existing.select(F.col("path").alias("p")).distinct().withColumn("there", F.lit(True))
    seen = each.join(good, "p", "left").join(there, "p", "left").groupBy("dataset", "path").agg(F.max("good").alias("good"), F.max("there").alias("there"))
    return seen.select("dataset", "path", F.when(F.col("good"), "verified").when(F.col("there"), "unverified").otherwise("missing").alias("status"))


def delivery_summary(report: DataFrame) -> DataFrame:
    """(dataset, status, files, missing, unverified): one row for each data set of an unpack report."""
    lost = F.count_if(F.col("status") != "verified")
    one = report.groupBy("dataset").agg(F.count("*").alias("files"), lost.alias("missing"), F.count_if(F.col("status") == "unverified").alias("unverified"))
    return one.select("dataset", F.when(F.col("missing") > 0, "missing-inputs").otherwise("unpacked").alias("status"), "files", "missing", "unverified")


def verify_index(index: DataFrame, digests: DataFrame, reference: DataFrame, columns: list[str], files: dict[str, str], key: str = "image_ref") -> DataFrame:
    """(key, rule, detail) of all problems of an index.

    ``files`` maps path columns to those of their SHA-256; ``digests`` (path, sha256) are
    the files as they are.  ``columns`` must equal the reference's; both must have the same keys.
    """
    found = index.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit("repeated").alias("rule"), F.col("n").cast("string").alias("detail"))
    # all files of a row meet their digests in one shuffle
    each = index.select(key, F.explode(F.array(*(F.struct(F.lit(p).alias("column"), F.col(p).alias("path"), F.col(d).alias("expected")) for p, d in files.items()))).alias("f")).select(key, "f.*")
    seen = each.join(digests.select("path", "sha256"), "path", "left")
    wrong = F.when(F.col("sha256").isNull(), "file_missing").when(F.col("sha256") != F.col("expected"), "file_modified")
    found = found.unionByName(seen.withColumn("rule", wrong).filter("rule IS NOT NULL").select(key, "rule", F.col("column").alias("detail")))
    left, right = index.dropDuplicates([key]).alias("l"), reference.alias("r")
    j = left.join(right, F.col(f"l.{key}") == F.col(f"r.{key}"), "full")
    other = F.array_compact(F.array(*(F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in columns)))
    rule = F.when(F.col(f"r.{key}").isNull(), "not_in_reference").when(F.col(f"l.{key}").isNull(), "not_in_index").when(F.size(other) > 0, "differs")
    both = j.select(F.coalesce(f"l.{key}", f"r.{key}").alias(key), rule.alias("rule"), F.when(rule == "differs", F.array_join(other, ",")).alias("detail"))
    return found.unionByName(both.filter("rule IS NOT NULL"))


def order_problem(references: Column, images: Column) -> Column:
    """Why a JSON list of references disagrees with image paths; null where it is absent or agrees."""
    listed = F.from_json(references, "array<string>")
    return F.when(references.isNull(), None).when(listed.isNull(), "invalid").when(~listed.eqNullSafe(images), "order")


def rebuilt(rows: DataFrame, images: DataFrame, key: str, refs: str) -> DataFrame:
    """Rows with their embedded images in the order of ``refs`` (array of names); null for a row that lacks one.

    ``images`` is (name, content).  Names are joined as keys; no image is broadcast.
    """
    each = rows.select(key, F.posexplode(refs).alias("pos", "name")).join(images.select("name", "content"), "name", "left")
    whole = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "content"))).alias("_all"), F.bool_and(F.col("content").isNotNull()).alias("_whole"))
    kept = F.when(F.col("_whole"), F.transform("_all", lambda x: F.struct(x["name"].alias("name"), x["content"].alias("content"))))
    return rows.join(whole, key, "left").withColumn("embedded", kept).drop("_all", "_whole")


def substitute_paths(rows: DataFrame, assets: DataFrame, key: str, paths: str) -> DataFrame:
    """Rows whose array ``paths`` holds the assets' paths (image_ref, asset_path) in place of references; unknown ones stay."""
    each = rows.select(key, F.posexplode(paths).alias("pos", "image_ref")).join(assets.select("image_ref", "asset_path"), "image_ref", "left")
    put = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("asset_path", "image_ref").alias("path")))).alias("_put"))
    return rows.join(put, key, "left").withColumn(paths, F.coalesce(F.transform("_put", lambda x: x["path"]), F.col(paths))).drop("_put")


def manifest_warning(recorded: DataFrame, digest: str, column: str = "manifest_sha256", by: list[str] | None = None) -> DataFrame:
    """(by..., warning): runs whose rows disagree on the manifest's digest, or agree on another than ``digest``; without ``by`` all rows are one run."""
    by = by or []
    one = recorded.filter(F.length(column) > 0).groupBy(*by).agg(F.count_distinct(column).alias("n"), F.min(column).alias("only"))
    text = F.when(F.col("n") > 1, F.concat(F.lit("rows disagree: "), F.col("n").cast("string"))).when((F.col("n") == 1) & (F.col("only") != digest), F.concat(F.lit("recorded as "), "only"))
    return one.select(*by, text.alias("warning")).filter("warning IS NOT NULL")
