"""Building a benchmark's frames as one flow, and its verification.

``build`` goes through preflight, materialising, indexing, verifying and publishing;
each step is a DataFrame, a finished one is taken over by a resumed run, and all that is
wrong is reported together, not only the first problem.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import contract, delivery
from .run import Run
from .sources import files, sinks

#: What an index must have to be verified against a reference.
COMPARED = ["dataset", "scene_id", "loader_frame_idx", "rgb_sha256", "depth_sha256", "image_height", "image_width"]


def requests(manifest: DataFrame) -> DataFrame:
    """(image_ref, dataset, scene_id, frame_id, identities) of every frame a manifest needs.

    ``identities`` is the number of different identities that rows give to one reference.
    """
    each = manifest.select("dataset", "scene_id", F.explode(F.concat("input_images", "target_images")).alias("x"))
    one = each.select(F.col("x.image_path").alias("image_ref"), F.struct("dataset", "scene_id", F.col("x.frame_id").cast("bigint").alias("frame_id")).alias("id"))
    return one.groupBy("image_ref").agg(F.min("id").alias("id"), F.count_distinct("id").alias("identities")).select("image_ref", "id.*", "identities")


def preflight(wanted: DataFrame, sources: DataFrame, calibration: DataFrame) -> DataFrame:
    """(image_ref, problem): conflicting identities, sources that are missing or given twice, frames without camera.

    ``sources`` is (image_ref, image_path, depth_path), ``calibration`` (image_ref, extrinsics_c2w, intrinsics).
    """
    given = sources.groupBy("image_ref").agg(F.count("*").alias("given"), F.count_if(F.col("image_path").isNull() | F.col("depth_path").isNull()).alias("holes"))
    cameras = calibration.groupBy("image_ref").agg(F.count("*").alias("cameras"))
    j = wanted.join(given, "image_ref", "left").join(cameras, "image_ref", "left")
    rules = {
        "identity": F.col("identities") > 1,
        "source_missing": F.coalesce(F.col("given"), F.lit(0)) == 0,
        "source_repeated": F.col("given") > 1,
        "source_incomplete": F.col("holes") > 0,
        "camera_missing": F.coalesce(F.col("cameras"), F.lit(0)) == 0,
        "camera_repeated": F.col("cameras") > 1,
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return j.select("image_ref", F.explode(found).alias("problem"))


def problem_list(problems: DataFrame, shown: int = 5) -> list[str]:
    """A line for each kind of problem, with the first references: what a user is to mend."""
    top = F.slice(F.array_sort(F.collect_set("image_ref")), 1, shown)
    # the references of a kind are cut to a few in each task first
    few = problems.groupBy("problem", F.pmod(F.xxhash64("image_ref"), F.lit(64)).alias("part")).agg(F.count("*").alias("n"), top.alias("refs"))
    rows = few.groupBy("problem").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("refs"))), 1, shown).alias("refs")).orderBy("problem").collect()
    return [f"{r['problem']}: {', '.join(r['refs'])}" + (f" +{r['n'] - len(r['refs'])} more" if r["n"] > len(r["refs"]) else "") for r in rows]


def build(spark: SparkSession, manifest: DataFrame, sources: DataFrame, calibration: DataFrame, folder: str, revision: str, reference: DataFrame | None = None, settings: Mapping[str, Any] | None = None, resume: bool = False) -> dict[str, Any]:
    """Materialise all frames a manifest needs under ``folder`` and publish their index there.

    Returns the build report.  Problems before or after materialising are one error that
    lists them; nothing is published then, and a resumed build goes on from the stages
    that are finished.
    """
    run = Run(spark, f"{folder}/.build", {"revision": revision, **(settings or {})}, {"manifest": manifest, "sources": sources, "calibration": calibration}, resume)
    wanted = run.stage("requests", lambda: requests(manifest))
    before = problem_list(preflight(wanted, sources, calibration))
    if before:
        raise ValueError("; ".join(before))

    def copied() -> DataFrame:
        j = wanted.join(sources, "image_ref")
        base = F.concat(F.lit(f"{folder}/frames/"), F.sha2(F.col("image_ref").cast("binary"), 256))
        each = F.array(*(F.struct(F.col(f"{k}_path").alias("source"), F.concat(base, F.lit(f"_{k}"), F.lower(F.regexp_extract(f"{k}_path", r"(\.[^./]+)$", 1))).alias("destination"), F.lit(k).alias("kind")) for k in ("image", "depth")))
        pairs = j.select("image_ref", F.explode(each).alias("x")).select("image_ref", "x.*")
        done = files.copy_files(pairs.select("source", "destination"))
        return pairs.join(done.drop("source"), "destination")

    stored = run.stage("copies", copied)
    failed = problem_list(stored.filter("status <> 'copied'").select("image_ref", F.concat_ws("_", "kind", "status").alias("problem")))
    if failed:
        raise ValueError("; ".join(failed))

    def indexed() -> DataFrame:
        side = stored.groupBy("image_ref").agg(*(F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{n}_{s}") for k, n in (("image", "image"), ("depth", "depth")) for c, s in (("destination", "path"), ("sha256", "sha256"))))
        side = side.withColumnsRenamed({"image_sha256": "rgb_sha256"})
        rows = wanted.join(side, "image_ref").join(calibration, "image_ref").withColumnRenamed("frame_id", "loader_frame_idx").drop("identities")
        return sinks.frame_index(rows.withColumn("asset_revision", F.lit(revision)), ["image_ref", "image_path", "depth_path"])

    index = run.stage("index", indexed)
    wrong = verify(index, manifest, reference)
    if wrong:
        raise ValueError("; ".join(wrong))
    sinks.stage_and_swap(index, f"{folder}/eval_frames")
    return run.report(status="built", frames=index.count())


def verify(index: DataFrame, manifest: DataFrame, reference: DataFrame | None = None, digests: DataFrame | None = None) -> list[str]:
    """What is wrong with an index, a line a kind: its own rules, its files and, where given, a frozen reference."""
    found = contract.check_frames(index, manifest, digests).withColumnRenamed("rule", "problem")
    identity = index.join(requests(manifest).withColumnsRenamed({"dataset": "d", "scene_id": "s", "frame_id": "f"}), "image_ref").filter("NOT (dataset <=> d AND scene_id <=> s AND loader_frame_idx <=> f)")
    found = found.unionByName(identity.select("image_ref", F.lit("identity").alias("problem")))
    if reference is not None:
        own = [c for c in COMPARED if c in index.columns and c in reference.columns]
        files_there = digests if digests is not None else index.select(F.explode(F.array(F.struct(F.col("image_path").alias("path"), F.col("rgb_sha256").alias("sha256")), F.struct(F.col("depth_path").alias("path"), F.col("depth_sha256").alias("sha256")))).alias("x")).select("x.*").distinct()
        other = delivery.verify_index(index, files_there, reference, own, {"image_path": "rgb_sha256", "depth_path": "depth_sha256"})
        found = found.unionByName(other.select("image_ref", F.concat_ws(":", "rule", "detail").alias("problem")))
    return problem_list(found.withColumn("image_ref", F.coalesce("image_ref", F.lit("-"))))
