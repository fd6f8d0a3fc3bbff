"""Contracts of manifests, predictions, labels and frames; the scoring path over them.

Every check gives a table of violations; ``rules.first_violation`` and
``rules.assert_clean`` turn it into the first error of a fail-fast check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from . import fold, rules
from .rules import Rule

# Fixed values of the formats.
VERSION, NAMESPACE = "0.1", "evaluator-v0.1"
DATASETS = ["hypersim", "matterport3d", "scannet", "scannetpp", "synthetic"]
SAFE_ID = "^[A-Za-z0-9][A-Za-z0-9._+-]*$"
DIGEST = "^[0-9a-f]{64}$"
ROOTED = r"^(?:/|[A-Za-z]:[\\/])"


def _filled(c: str | Column) -> Column:
    return F.length(c) > 0


def _images(c: str) -> Column:
    return F.forall(c, lambda x: _filled(x["role"]) & _filled(x["image_path"]) & x["frame_id"].isNotNull())


def manifest_rules() -> list[Rule]:
    """Field rules (priority 0), then rules between fields (priority 1)."""
    n = F.size("instructions")
    paths = [F.transform(c, lambda x: x["image_path"]) for c in ("input_images", "target_images")]
    fields = [Rule(c, _filled(c)) for c in ("sample_id", "root_sample_id", "scene_id", "instruction_type", "subtype")]
    fields += [
        Rule("dataset", F.col("dataset").isin(DATASETS)),
        Rule("context_type", F.col("context_type").isin("single", "multi")),
        Rule("num_context_images", F.col("num_context_images").between(1, 4)),
        Rule("input_images", F.size("input_images").between(1, 4) & _images("input_images")),
        Rule("target_images", (F.size("target_images") >= 1) & _images("target_images")),
        Rule("instructions", (n >= 1) & F.forall("instructions", lambda x: (x["step"] >= 1) & _filled(x["text"]))),
        Rule("evaluation_protocol", _filled("evaluation_protocol.call_mode") & (F.col("evaluation_protocol.num_model_calls") >= 1) & F.col("evaluation_protocol.use_teacher_forcing").isNotNull()),
        Rule("pose_metadata", F.schema_of_variant(F.try_parse_json("pose_metadata")).startswith("OBJECT")),
    ]
    return fields + [
        Rule("safe_id", F.col("sample_id").rlike(SAFE_ID), 1),
        Rule("context_count", F.col("num_context_images") == F.size("input_images"), 2),
        Rule("contiguous_steps", (n >= 1) & F.forall(F.transform("instructions", lambda x, i: x["step"] == i + 1), lambda ok: ok), 3),
        Rule("target_count", F.size("target_images") == n, 4),
        Rule("call_count", F.col("evaluation_protocol.num_model_calls") == n, 5),
        Rule("leakage", ~F.arrays_overlap(*paths) | (F.lower("instruction_type") == "cycle"), 6),
    ]


def check_manifest(manifest: DataFrame) -> DataFrame:
    """(row_no, sample_id, rule, priority) of all violations, repeated ids included."""
    found = rules.violations(manifest, ["row_no", "sample_id"], manifest_rules())
    n = F.row_number().over(Window.partitionBy("sample_id").orderBy("row_no"))
    again = manifest.select("row_no", "sample_id", n.alias("n")).filter("n > 1").select("row_no", "sample_id", F.lit("repeated_id").alias("rule"), F.lit(7).alias("priority"))
    return found.unionByName(again)


def expected_steps(manifest: DataFrame) -> DataFrame:
    """One row per step in manifest order: ids, current view, target, instruction, auxiliary context."""
    rows = manifest.select("row_no", "sample_id", "dataset", "scene_id", "subtype", "input_images", "target_images", F.posexplode("instructions").alias("pos", "instruction"))
    target = F.get("target_images", F.col("pos"))
    current = F.when(F.col("pos") == 0, F.get("input_images", F.lit(0))["image_path"]).otherwise(F.get("target_images", F.col("pos") - 1)["image_path"])
    step = F.col("instruction.step")
    return rows.select(
        "row_no", F.col("pos").alias("step_no"), F.col("sample_id").alias("case_id"), step.alias("step_id"), F.concat("sample_id", F.lit("__step"), step.cast("string")).alias("id"), "dataset", "scene_id", "subtype",
        current.alias("current_path"), target["image_path"].alias("target_path"), F.transform(F.slice("input_images", 2, 3), lambda x: x["image_path"]).alias("context_paths"), "instruction",
    )


def prediction_rules(manifest_sha256: str) -> list[Rule]:
    return [
        Rule("benchmark_version", F.col("benchmark_version") == VERSION),
        Rule("manifest_sha256", F.col("manifest_sha256").rlike(DIGEST)),
        Rule("model_id", F.col("model_id").rlike(SAFE_ID) & (F.length("model_id") <= 128)),
        Rule("model_type", F.col("model_type").isin(*labels.MODEL_TYPES)),
        Rule("case_id", _filled("case_id")),
        Rule("step_id", F.col("step_id") >= 1),
        Rule("output_path", _filled("output_path") & ~F.col("output_path").rlike(ROOTED) & ~F.array_contains(F.split("output_path", "[/\\\\]"), "..")),
        Rule("output_sha256", F.col("output_sha256").rlike(DIGEST)),
        Rule("interface_type", F.col("interface_type").isin(*labels.INTERFACES)),
        Rule("input_ids", (F.size("input_ids") >= 1) & F.forall("input_ids", _filled)),
        Rule("prompt_sha256", F.col("prompt_sha256").rlike(DIGEST)),
        Rule("other_manifest", F.col("manifest_sha256") == manifest_sha256),
    ]


def check_predictions(predictions: DataFrame, manifest: DataFrame, manifest_sha256: str, digests: DataFrame | None = None) -> DataFrame:
    """(priority, row_no, rule, case_id, step_id): field errors, mixed models, repeats, unexpected, missing, order, digests.

    ``digests`` (output_path, sha256) are those of the files that are there.
    """
    keys = ["case_id", "step_id"]
    out = ["priority", "row_no", "rule", *keys]
    wanted = expected_steps(manifest).select(*keys, F.col("row_no").alias("w_row"), "step_no")
    field = rules.violations(predictions, ["row_no", *keys], prediction_rules(manifest_sha256)).select(*out)

    def as_rule(df: DataFrame, name: str, priority: int) -> DataFrame:
        return df.select(F.lit(priority).alias("priority"), "row_no", F.lit(name).alias("rule"), *keys)

    first = predictions.agg(F.min_by("model_id", "row_no").alias("first_model"))
    mixed = predictions.join(F.broadcast(first), F.col("model_id") != F.col("first_model"))  # one row
    place = Window.partitionBy(*keys).orderBy("row_no")
    repeated = predictions.withColumn("n", F.row_number().over(place)).filter("n > 1")
    unexpected = predictions.join(wanted, keys, "left_anti")
    lost = wanted.join(predictions, keys, "left_anti").withColumn("row_no", F.col("w_row"))
    # rows are in order where no row stands before one of a smaller key: each row against its neighbour only
    pairs = predictions.select(F.col("row_no"), *keys).join(wanted, keys).select("row_no", *keys, F.struct("w_row", "step_no").alias("at"))
    following = pairs.select((F.col("row_no") - 1).alias("before"), F.col("at").alias("next_at"))
    order = pairs.join(following, F.col("row_no") == F.col("before")).filter("next_at < at")
    parts = [field, as_rule(mixed, "mixed_models", 1), as_rule(repeated, "repeated", 2), as_rule(unexpected, "unexpected", 3), as_rule(lost, "missing", 4), as_rule(order, "order", 5)]
    if digests is not None:
        files = digests.select(F.col("output_path").alias("path"), "sha256")
        wrong = predictions.join(files, F.col("output_path") == F.col("path"), "left").filter("NOT (sha256 <=> output_sha256)")
        parts.append(as_rule(wrong, "digest", 6))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def prediction_report(found: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: total, missing, repeated, unexpected, digest errors."""
    kinds = ["missing", "repeated", "unexpected", "digest"]
    total = predictions.count()
    return found.agg(*(F.count_if(F.col("rule") == k).alias(k) for k in kinds)).withColumn("total", F.lit(total))


def build_predictions(manifest: DataFrame, generated: DataFrame, model_id: str, model_type: str, manifest_sha256: str) -> DataFrame:
    """Prediction rows for generated files (case_id, step_id, output_path, output_sha256), in manifest order."""
    steps = expected_steps(manifest).join(manifest.select(F.col("sample_id").alias("case_id"), "num_context_images"), "case_id")
    j = steps.join(generated, ["case_id", "step_id"])
    kind = labels.model_type(F.lit(model_type))
    return j.select(
        F.row_number().over(Window.partitionBy("row_no").orderBy("step_no")).alias("place"), "row_no", F.lit(VERSION).alias("benchmark_version"), F.lit(manifest_sha256).alias("manifest_sha256"), F.lit(model_id).alias("model_id"), kind.alias("model_type"),
        "case_id", "step_id", "output_path", "output_sha256", labels.interface_type(kind, F.col("num_context_images")).alias("interface_type"),
        labels.input_ids(F.col("case_id"), F.col("step_id"), F.col("num_context_images")).alias("input_ids"), F.sha2(F.col("instruction.text").cast("binary"), 256).alias("prompt_sha256"),
    )


def evaluator_input(manifest: DataFrame, predictions: DataFrame, label_bank: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Steps with their generated file, labels by position and, where given, the target's frame."""
    bank = label_bank.select(F.col("sample_id").alias("case_id"), F.posexplode("target_labels").alias("step_no", "target_label"))
    j = expected_steps(manifest).join(predictions.select("case_id", "step_id", F.col("output_path").alias("generated_path")), ["case_id", "step_id"]).join(bank, ["case_id", "step_no"])
    names = F.coalesce(F.when(F.size("target_label.detector_prompt_labels") > 0, F.col("target_label.detector_prompt_labels")), F.col("target_label.object_labels"))
    j = j.withColumn("object_prompts", labels.distinct_labels(names, 64)).drop("target_label")
    if frames is None:
        return j
    cols = ["image_ref", "asset_id", "image_path", "depth_path", "extrinsics_c2w", "intrinsics"]
    return j.join(frames.select(*cols), F.col("target_path") == F.col("image_ref"), "left").drop("image_ref")


def check_label_bank(bank: DataFrame, manifest: DataFrame) -> DataFrame:
    """(sample_id, rule): empty label lists, repeated ids, lists of another length than the targets."""
    sizes = manifest.select(F.col("sample_id").alias("m"), F.size("target_images").alias("n"))
    fine = F.forall("target_labels", lambda x: (F.coalesce(F.size(x["detector_prompt_labels"]), F.lit(0)) > 0) | (F.coalesce(F.size(x["object_labels"]), F.lit(0)) > 0))
    j = bank.join(sizes, F.col("sample_id") == F.col("m"), "left")
    found = rules.violations(j, ["sample_id"], [Rule("labels", (F.size("target_labels") > 0) & fine), Rule("length", F.size("target_labels") == F.col("n"))]).select("sample_id", "rule")
    return found.union(rules.duplicates(bank, ["sample_id"]).select("sample_id", F.lit("repeated")))


def check_frames(frames: DataFrame, manifest: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """(image_ref, rule): identities, matrices, one revision, coverage of the manifest and file digests."""
    needed = manifest.select(F.explode(F.concat("input_images", "target_images")).alias("x")).select(F.col("x.image_path").alias("need")).distinct()
    m = F.col("extrinsics_c2w")
    det = m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    shape = (F.size(m) == 4) & F.forall(m, lambda r: (F.size(r) == 4) & F.forall(r, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    last = m[3] == F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))
    pose = F.when(shape, last & (F.abs(det) >= 1e-8))
    focal = F.when(F.size("intrinsics") == 3, (F.col("intrinsics")[0][0] > 0) & (F.col("intrinsics")[1][1] > 0))
    found = rules.violations(frames, ["image_ref"], [Rule("pose", pose), Rule("intrinsics", focal), Rule("size", (F.col("image_height") > 0) & (F.col("image_width") > 0))]).select("image_ref", "rule")
    for key, name in ((["image_ref"], "repeated_ref"), (["asset_id"], "repeated_asset"), (["dataset", "scene_id", "loader_frame_idx"], "repeated_frame")):
        bad = frames.groupBy(*key).agg(F.count("*").alias("n"), F.min("image_ref").alias("ref")).filter("n > 1")
        found = found.union(bad.select(F.col("ref").alias("image_ref"), F.lit(name)))
    lost = needed.join(frames, F.col("need") == F.col("image_ref"), "left_anti").select("need", F.lit("not_covered"))
    spare = frames.join(needed, F.col("need") == F.col("image_ref"), "left_anti").select("image_ref", F.lit("not_needed"))
    one = frames.agg(F.min("asset_revision").alias("a"), F.max("asset_revision").alias("b"), F.count_if(F.col("asset_revision").isNull()).alias("n")).filter("a <> b OR n > 0").select(F.lit(None).cast("string"), F.lit("revision"))
    found = found.union(lost).union(spare).union(one)
    if digests is not None:
        for path, digest, name in (("image_path", "rgb_sha256", "rgb_digest"), ("depth_path", "depth_sha256", "depth_digest")):
            d = digests.select(F.col("path").alias("p"), "sha256")
            found = found.union(frames.join(d, F.col(path) == F.col("p"), "left").filter(f"NOT (sha256 <=> {digest})").select("image_ref", F.lit(name)))
    return found


def file_digests(files: DataFrame) -> DataFrame:
    """(path, sha256) of listed files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def with_subtype(records: DataFrame) -> DataFrame:
    return records.withColumns({"subtype": labels.subtype_of(F.col("id")), "case_id": labels.case_of(F.col("id"))})


def check_records(pose: DataFrame, objects: DataFrame) -> DataFrame:
    """(id, rule): ids without subtype or step, repeats, ids of one family only."""
    both = pose.select("id", F.lit("pose").alias("family")).union(objects.select("id", F.lit("object").alias("family")))
    broken = rules.violations(both, ["id"], [Rule("subtype", labels.subtype_of(F.col("id")).isNotNull()), Rule("step", labels.step_of(F.col("id")).isNotNull())]).select("id", "rule")
    per = both.groupBy("id").agg(F.count_if(F.col("family") == "pose").alias("a"), F.count_if(F.col("family") == "object").alias("b"))
    return broken.union(per.filter("a > 1 OR b > 1").select("id", F.lit("repeated"))).union(per.filter("a = 0 OR b = 0").select("id", F.lit("one_family")))


def result(pose: DataFrame, objects: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """The result document's one row; a missing subtype or provenance field is an error."""
    for field in ("benchmark_version", "evaluator_version", "manifest_sha256", "code_commit"):
        if not provenance.get(field):
            raise ValueError(f"missing result provenance field: {field}")
    a = fold.macro_score(with_subtype(pose))
    kinds = fold.pillar_fold(with_subtype(objects))
    b = kinds.agg(*(F.max(F.when(F.col("subtype") == k, F.col("ssp"))).alias(f"ssp_{k}") for k in labels.SUBTYPES))
    b = b.withColumn("ssp", (F.col("ssp_atomic") + F.col("ssp_chain") + F.col("ssp_cycle")) / 3)
    names = [*(f"cmg_{k}" for k in labels.SUBTYPES), "cmg", *(f"ssp_{k}" for k in labels.SUBTYPES), "ssp"]
    none = F.lit(None).cast("double")
    rows = a.select(*(F.col(c) if c.startswith("cmg") else none.alias(c) for c in names), "num_valid_steps").union(b.select(*(F.col(c) if c.startswith("ssp") else none.alias(c) for c in names), F.lit(None).cast("bigint")))
    one = rows.agg(*(F.max(c).alias(c) for c in names), F.max("num_valid_steps").alias("eligible"))
    one = fold.assert_complete(fold.assert_complete(one, "cmg"), "ssp")
    given = [F.lit(str(v)).alias(k) for k, v in provenance.items()]
    return one.select(F.lit(NAMESPACE).alias("result_namespace"), *given, "eligible", F.col("eligible").alias("evaluated"), F.lit(0).alias("missing"), F.lit(0).alias("failed"), *names, ((F.col("cmg") + F.col("ssp")) / 2).alias("overall"))


def score_predictions(manifest: DataFrame, predictions: DataFrame, pose: DataFrame, objects: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """Check everything, then fold: the engine's one-call surface."""
    rules.assert_clean(check_manifest(manifest), ["row_no"])
    rules.assert_clean(check_predictions(predictions, manifest, provenance["manifest_sha256"]), ["row_no"])
    rules.assert_clean(check_records(pose, objects).withColumn("priority", F.lit(0)), ["id"])
    return result(pose, objects, provenance)
