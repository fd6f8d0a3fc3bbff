"""Older shapes of case documents: labels in nested places, field picks by protocol, names and tokens.

A case document is a VARIANT column; a path that is missing or of another kind gives null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import distinct_labels, normalise

#: Where older documents keep prompt labels, in the order in which they count; a list of
#: objects is written with ``[]`` and the member that is taken.
LABEL_PLACES = [
    "$.object_prompt_labels",
    "$.detector_prompt_labels",
    "$.stage2.detector_prompt_labels",
    "$.stage2.vlm.object_anchor_tags.detector_prompt_labels",
    "$.stage2.vlm.object_anchor_tags.main_objects[].category",
    "$.stage2.vlm.object_anchor_tags.primary_anchor.category",
    "$.stage2.vlm.object_anchor_tags.repeated_instance_groups[].category",
    "$.stage2.vlm.spatial_relation_tags.camera_object_relations[].object",
    "$.stage2.vlm.spatial_relation_tags.object_object_depth_pairs[].front,back",
    "$.stage2.vlm.spatial_relation_tags.object_object_left_right_pairs[].left,right",
    "$.stage2.vlm.spatial_relation_tags.object_region_relations[].object",
]
#: Where documents of a protocol keep their context frames and their target.
CONTEXT_PLACES = {"two_image_instruction": ["$.input.image_1", "$.input.image_2"], "single_image_cycle": ["$.input_forward.image"]}
OTHER_CONTEXT, LAST_CONTEXT = ["$.input.image"], ["$.input.image", "$.input.image_1", "$.input.image_2"]
#: Fixed value: a scene that its source renamed.
SCENE_ALIASES = {"7104910700": "7104910700000"}


def _none() -> Column:
    return F.array().cast("array<string>")


def text_at(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "string")


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strings_at(doc: Column, path: str) -> Column:
    """The strings at a path as an array: a list's members, or a single value."""
    many = F.try_variant_get(doc, path, "array<string>")
    one = _once(text_at(doc, path), lambda t: F.when(t.isNotNull(), F.array(t)))
    return F.coalesce(many, one, _none())


def members_at(doc: Column, path: str, names: list[str]) -> Column:
    """Members of the objects of a list: the names of the first object, then of the second, and so on."""
    objects = F.coalesce(F.try_variant_get(doc, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.flatten(F.transform(objects, lambda o: F.array(*(F.try_variant_get(o, f"$.{n}", "string") for n in names))))


def prompt_labels(doc: Column, most: int = 20) -> Column:
    """Labels of all places, normalised, without repeats, ``most`` at most."""
    found = []
    for place in LABEL_PLACES:
        path, _, names = place.partition("[].")
        found.append(members_at(doc, path, names.split(",")) if names else strings_at(doc, path))
    return distinct_labels(F.concat(*found), most)


def step_labels(target: Column, records: Column, place: Column, step: Column, most: int = 20) -> Column:
    """Frozen labels of a step: the target's own, else those of the record of exactly this step; never both.

    ``target`` is a target frame's VARIANT, ``records`` an array of VARIANT step records,
    ``place`` the step's position (from 0) and ``step`` its number.
    """

    def given(v: Column) -> Column:
        # a lambda's variable is worked out once, however often it is named
        first = strings_at(v, "$.detector_prompt_labels")
        return _once(first, lambda f: F.when(F.size(f) > 0, f).otherwise(strings_at(v, "$.object_labels")))

    def number(r: Column) -> Column:
        return F.try_variant_get(r, "$.step", "int")

    def of_record(records: Column) -> Column:
        here = F.get(records, place)
        exact = F.when(F.coalesce(number(here), step) == step, here)
        exact = F.coalesce(exact, F.get(F.filter(records, lambda r: number(r) == step), F.lit(0)))
        return _once(exact, lambda e: distinct_labels(_once(F.coalesce(F.try_variant_get(e, "$.qwen3vl_gt_object_labels", "variant"), e), given), most))

    own = distinct_labels(_once(F.try_variant_get(target, "$.qwen3vl_gt_object_labels", "variant"), given), most)
    return _once(own, lambda o: F.when(F.coalesce(F.size(o), F.lit(0)) > 0, o).otherwise(F.coalesce(_once(records, of_record), _none())))


def frame_path(frame: Column) -> Column:
    """A frame is a path or an object with one."""
    names = ("image_path", "path", "image", "file")
    bare = F.when(F.schema_of_variant(frame) == "STRING", frame.try_cast("string") if hasattr(frame, "try_cast") else frame.cast("string"))
    return F.coalesce(*(F.nullif(F.try_variant_get(frame, f"$.{n}", "string"), F.lit("")) for n in names), F.nullif(bare, F.lit("")))


def case_frames(doc: Column) -> Column:
    """(context: array of paths, target: path) of a document of any shape.

    A list of context frames wins, then input and target images, then the places of the protocol.
    """

    def frames(path: str) -> Column:
        return F.try_variant_get(doc, path, "array<variant>")

    def one(path: str) -> Column:
        return F.try_variant_get(doc, path, "variant")

    def paths(found: Column) -> Column:
        return F.array_compact(F.transform(found, frame_path))

    def at(places: list[str]) -> Column:
        return F.array_compact(F.array(*(frame_path(one(p)) for p in places)))

    def last(path: str) -> Column:
        return frame_path(F.try_element_at(frames(path), F.lit(-1)))

    protocol = F.coalesce(text_at(doc, "$.protocol"), F.lit(""))
    by = at(OTHER_CONTEXT)
    for name, places in CONTEXT_PLACES.items():
        by = F.when(protocol == name, at(places)).otherwise(by)
    by = F.when(F.size(by) > 0, by).otherwise(at(LAST_CONTEXT))
    goal = F.coalesce(
        F.when(protocol == "single_image_3step_chain", last("$.targets")),
        F.when(protocol == "single_image_cycle", frame_path(one("$.target_forward"))),
        frame_path(one("$.target")),
        last("$.targets"),
        frame_path(one("$.target_forward")),
    )
    old, new = F.size(frames("$.context")) > 0, F.size(frames("$.input_images")) > 0
    new_goal = F.coalesce(frame_path(F.get(frames("$.target_images"), F.lit(0))), frame_path(one("$.target_image")))
    context = F.when(old, paths(frames("$.context"))).when(new, paths(frames("$.input_images"))).otherwise(by)
    target = F.when(old, frame_path(one("$.target"))).when(new, new_goal).otherwise(goal)
    return F.struct(context.alias("context"), target.alias("target"))


def original_step(doc: Column) -> Column:
    """The benchmark step that a rerun of a cycle's second step stands for; null in other documents."""
    n = F.try_variant_get(doc, "$.cycle_step2_strict_rerun.original_cycle_step", "int")
    return F.when(n > 0, n)


def source_frame(doc: Column) -> Column:
    """The frame a rerun starts from: the one before its original step."""
    return F.get(F.try_variant_get(doc, "$.frame_ids", "array<string>"), original_step(doc) - 1)


def number_of_steps(doc: Column, targets: Column) -> Column:
    """The length of the original trajectory: of a rerun that of its frames, else the number of targets."""
    step, frames = original_step(doc), F.size(F.try_variant_get(doc, "$.frame_ids", "array<string>"))
    return F.when(step.isNull(), targets).when(frames >= 2, F.greatest(step, frames - 1)).otherwise(F.greatest(step, targets))


def step_number(doc: Column, place: Column) -> Column:
    """The benchmark number of the step at ``place`` (from 0)."""
    return F.coalesce(original_step(doc), place + 1)


def _clean(value: Column) -> Column:
    token = F.regexp_replace(F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("unknown")), "[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(token, "^[._-]+|[._-]+$", ""), F.lit("")), F.lit("unknown"))


def file_token(value: Column, longest: int = 180) -> Column:
    """A name that any file system takes; a long one is cut and ends in 12 digits of its SHA-256.

    ``file_token_blake`` gives the names that older runs have for long values.
    """
    token = _clean(value)
    short = F.concat(F.left(token, F.lit(longest - 13)), F.lit("_"), F.left(F.sha2(token.cast("binary"), 256), F.lit(12)))
    return F.when(F.length(token) > longest, short).otherwise(token)


def file_token_blake(value: Column, longest: int = 180) -> Column:
    """``file_token`` with six bytes of BLAKE2b, which Spark lacks (Arrow batches)."""

    @F.pandas_udf("string")
    def cut(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: t if len(t) <= longest else f"{t[: longest - 13]}_{hashlib.blake2b(t.encode(), digest_size=6).hexdigest()}")

    return cut(_clean(value))


def image_key(path: Column, dataset: str) -> Column:
    """A source image's key: what follows the data set's folder, forward slashes, no ``scans`` folder in one data set."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    at = F.array_position(parts, dataset)
    parts = F.when(at > 0, F.slice(parts, at.cast("int") + 1, F.size(parts))).otherwise(parts)
    if dataset == "matterport3d":
        parts = F.when(F.get(parts, F.lit(0)) == "scans", F.slice(parts, 2, F.size(parts))).otherwise(parts)
    return F.array_join(parts, "/")


def official_scene(scene: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in SCENE_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, scene), scene)


def scene_and_camera(scene: Column) -> Column:
    """(scene, camera) of ``a__cam_b`` and ``a/cam_b``; the camera is null without one."""
    x = F.translate(scene, "\\", "/")
    joined, nested = r"(?s)^(.*)__cam_(.*)$", r"(?s)^(.*)/(cam_[^/]*)$"
    first = F.when(x.rlike(joined), F.regexp_extract(x, joined, 1)).when(x.rlike(nested), F.regexp_extract(x, nested, 1)).otherwise(x)
    camera = F.when(x.rlike(joined), F.concat(F.lit("cam_"), F.regexp_extract(x, joined, 2))).when(x.rlike(nested), F.regexp_extract(x, nested, 2))
    return F.struct(first.alias("scene"), camera.alias("camera"))


def catalogue(objects: Column, prefix: str) -> Column:
    """Lines that name objects (array of label and box) to a model: index, label and corners rounded half to even."""

    def corner(v: Column) -> Column:
        return F.bround(v, 0).cast("bigint").cast("string")

    def line(o: Column, i: Column) -> Column:
        box = F.array_join(F.array(*(corner(o["box"][c]) for c in ("x1", "y1", "x2", "y2"))), ", ")
        return F.concat(F.lit(f"- {prefix}"), i.cast("string"), F.lit(": label="), F.coalesce(normalise(o["label"]), F.lit("object")), F.lit(", box_xyxy=["), box, F.lit("]"))

    return F.when(F.size(objects) > 0, F.array_join(F.transform(objects, line), "\n")).otherwise(f"- No {prefix} objects.")
