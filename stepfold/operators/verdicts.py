"""Detector filters, match policies, verdicts that models returned, and what they change.

Inference stays outside: scores, boxes and verdicts enter as tables.  All are
expressions, keyed joins within a step and aggregates; the greedy choice itself is in
``match``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes, labels
from . import match
from .grid import meeting

#: Overlap a pair needs, and whether labels count by synonym group.
POLICIES = {"strict": (0.35, False), "relaxed": (0.25, True)}
#: What tells why an object was missed.
NEAR_IOU, FAR_CENTRE, MATCH_IOU, CENTRE_COST = 0.05, 0.25, 0.35, 0.3


def valid_boxes(detections: DataFrame, height: float, width: float, score: float = 0.25, least: int = 36, share: float = 0.0003, most: float = 0.65) -> DataFrame:
    """Detections (score, box ...) of at least ``score`` whose clamped box has a fitting area; ``box`` becomes the clamped one."""
    low = max(least, int(share * height * width))
    high = max(low + 1, int(most * height * width))
    safe = boxes.safe_box(F.col("box"), height, width)
    return detections.filter(F.col("score") >= score).withColumn("box", safe).filter(F.col("box").isNotNull() & boxes.area(F.col("box")).between(low, high))


def score_filter(detections: DataFrame, tau: float = 0.08, key: str = "step_id") -> DataFrame:
    """Detections of at least ``tau``; all of a step where none is."""
    best = F.max("score").over(Window.partitionBy(key))
    return detections.withColumn("_best", best).filter((F.col("score") >= tau) | (F.col("_best") < tau)).drop("_best")


def policy_candidates(truth: DataFrame, found: DataFrame, policy: str) -> DataFrame:
    """(step_id, gt_idx, pred_idx, iou) of pairs that a policy lets match.

    ``truth`` has step_id, gt_idx, label, box and ``found`` step_id, pred_idx, label, box.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown match policy: {policy}")
    tau, synonyms = POLICIES[policy]

    def named(df: DataFrame, name: str) -> DataFrame:
        label = labels.canonical(F.col("label")) if synonyms else F.col("label")
        return df.withColumn("label", label).withColumnRenamed("box", name)

    pairs = named(truth, "a").join(named(found, "b"), ["step_id", "label"])
    return pairs.withColumn("iou", boxes.iou_eps(F.col("a"), F.col("b"))).filter(F.col("iou") >= tau).select("step_id", "gt_idx", "pred_idx", "iou")


#: The similarity and the centre distance that an assignment by appearance asks for.
IDENTITY_FLOOR, CENTRE_REACH = 0.78, 0.35


def appearance_candidates(truth: DataFrame, found: DataFrame, height: float, width: float, floor: float = IDENTITY_FLOOR, reach: float = CENTRE_REACH) -> DataFrame:
    """(step_id, gt_idx, pred_idx, similarity, centre, iou, weight) of pairs that may be one object by appearance.

    ``truth`` and ``found`` have step_id, an index, box and feature (array of doubles, null or
    zero where none could be taken: such objects have no candidates).  Labels and overlap
    play no part; only pairs within ``reach`` of each other (as a share of the diagonal) are looked at, through the
    grid.  The weight is the similarity (cosine as 0 to 1) above the floor, a little over nothing at the floor itself.
    """
    far = reach * (height**2 + width**2) ** 0.5

    def at(df: DataFrame, name: str, slack: float) -> DataFrame:
        b = F.col("box")
        x, y = boxes.center_x(b), boxes.center_y(b)
        df = df.withColumn("at", boxes.box(x - slack, y - slack, x + slack, y + slack))
        return df.select("step_id", name, "box", F.col("feature").cast("array<double>").alias("feature"), "at")

    pair = meeting(at(truth, "gt_idx", far), at(found, "pred_idx", 0.0), ["step_id"], "at", "at", cell=far)
    pair = pair.select("l.step_id", "l.gt_idx", "r.pred_idx", F.col("l.box").alias("a"), F.col("r.box").alias("b"), F.col("l.feature").alias("u"), F.col("r.feature").alias("v"))

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    size = F.sqrt(dot("u", "u") * dot("v", "v"))
    # greatest and least pass over nulls, so a size that is null or zero is told first
    similarity = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot("u", "v") / F.when(size > 0, size) + 1) / 2)))
    pair = pair.withColumns({"similarity": similarity, "centre": boxes.center_distance(F.col("a"), F.col("b"), height, width), "iou": boxes.iou(F.col("a"), F.col("b"))})
    good = pair.filter((F.col("centre") <= reach) & (F.col("similarity") >= floor))
    return good.select("step_id", "gt_idx", "pred_idx", "similarity", "centre", "iou", (F.col("similarity") - floor + 1e-12).alias("weight"))


def match_by(policy: str, truth: DataFrame, found: DataFrame, height: float = 0, width: float = 0, proposals: DataFrame | None = None, **options) -> DataFrame:
    """(step_id, gt_idx, pred_idx, score) of the pairs that a policy matches.

    ``strict`` and ``relaxed`` take pairs of a label greedily by overlap; ``assignment`` pairs by appearance
    for the greatest total, with dummies for what stays alone; ``verdict`` takes recorded
    ``proposals`` (see ``match.gated_match``) and falls back to ``strict`` where there are none at all.
    """
    if policy == "verdict" and proposals is None:
        policy = "strict"
    if policy in POLICIES:
        some = policy_candidates(truth, found, policy).withColumn("similarity", F.lit(0.0))
        return match.greedy_match(some).select("step_id", "gt_idx", "pred_idx", F.col("iou").alias("score"))
    if policy == "assignment":
        some = appearance_candidates(truth, found, height, width, **options)
        chosen = match.optimal_match(some.select("step_id", "gt_idx", "pred_idx", "weight")).drop("weight")
        return chosen.join(some, ["step_id", "gt_idx", "pred_idx"]).select("step_id", "gt_idx", "pred_idx", F.col("similarity").alias("score"))
    if policy == "verdict":
        return match.gated_match(proposals, **options).filter("status = 'match'").select("step_id", "gt_idx", "pred_idx", F.col("confidence").alias("score"))
    raise ValueError(f"unknown match policy: {policy}")


def _nearest(missing: DataFrame, found: DataFrame, height: float, width: float, name: str) -> DataFrame:
    """The detection of a step that lies best for each missing object: iou, centre (three decimals), label, label_ok."""
    b = found.select(F.col("step_id").alias("s"), "pred_idx", F.col("box").alias("b"), F.col("label").alias("l"))
    pair = missing.join(b, F.col("step_id") == F.col("s"))
    iou, centre = boxes.iou(F.col("box"), F.col("b")), boxes.center_distance(F.col("box"), F.col("b"), height, width)
    ok = labels.compatible(F.col("label"), F.col("l"))
    # the first of equal ones wins; nine places, so that the order of additions does not show
    rank = F.struct((-F.round(iou - CENTRE_COST * centre, 9)).alias("inv"), "pred_idx", F.bround(iou, 3).alias("iou"), F.bround(centre, 3).alias("centre"), F.col("l").alias("label"), ok.alias("label_ok"))
    return pair.groupBy("step_id", "gt_idx").agg(F.min(rank).alias(name))


def diagnose_missing(missing: DataFrame, raw: DataFrame, kept: DataFrame, height: float, width: float) -> DataFrame:
    """(step_id, gt_idx, raw, kept, reason): why each missing object (step_id, gt_idx, label, box) found no partner.

    ``raw`` are all detections (step_id, pred_idx, label, box), ``kept`` those left by filters.
    """
    j = missing.select("step_id", "gt_idx").join(_nearest(missing, raw, height, width, "raw"), ["step_id", "gt_idx"], "left")
    j = j.join(_nearest(missing, kept, height, width, "kept"), ["step_id", "gt_idx"], "left")
    weak = F.col("kept").isNull() | (F.col("kept.iou") < MATCH_IOU)
    reason = (
        F.when(F.col("raw").isNull(), "no_detections")
        .when((F.col("raw.iou") < NEAR_IOU) & (F.col("raw.centre") > FAR_CENTRE), "not_near")
        .when((F.col("raw.iou") >= NEAR_IOU) & weak & ~F.col("raw.label_ok"), "label")
        .when((F.col("raw.iou") >= NEAR_IOU) & weak & (F.col("raw.iou") < MATCH_IOU), "overlap")
        .when((F.col("raw.iou") >= NEAR_IOU) & weak, "filtered")
        .otherwise("contended")
    )
    return j.withColumn("reason", reason)


def with_verdicts(pairs: DataFrame, verdicts: DataFrame, fail_open: bool = True) -> DataFrame:
    """Pairs (step_id, gt_idx, pred_idx) with ``same`` and ``confidence``.

    A pair without an answer, or whose answer could not be read (same is null), counts as
    the same object with confidence 1 if ``fail_open``, else as another with 0.
    """
    j = pairs.join(verdicts.select("step_id", "gt_idx", "pred_idx", "same", "confidence"), ["step_id", "gt_idx", "pred_idx"], "left")
    known = F.col("same").isNotNull()
    return j.withColumns({"same": F.coalesce("same", F.lit(fail_open)), "confidence": F.when(known, boxes.clip01(F.coalesce("confidence", F.lit(0.5)))).otherwise(float(fail_open)), "answered": known})


def overlay(instances: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Instances whose ``well_formed`` a negative verdict clears; a positive or missing one changes nothing."""
    said = verdicts.select(*keys, F.col("well_formed").alias("_said"))
    return instances.join(said, keys, "left").withColumn("well_formed", F.col("well_formed") & F.coalesce("_said", F.lit(True))).drop("_said")


def best_refined(prompts: DataFrame, instances: DataFrame, least_area: float = 20, least_iou: float = 0.01) -> DataFrame:
    """(step_id, prompt_idx, idx, quality): of each prompt box the instance of greatest score plus overlap.

    ``prompts``: step_id, prompt_idx, box; ``instances``: step_id, idx, box, score (null is 1), area.
    """
    b = instances.filter(F.col("area") >= least_area).select(F.col("step_id").alias("s"), "idx", F.col("box").alias("b"), F.coalesce("score", F.lit(1.0)).alias("score"))
    pair = prompts.join(b, F.col("step_id") == F.col("s")).withColumn("iou", boxes.iou(F.col("box"), F.col("b"))).filter(F.col("iou") > least_iou)
    best = F.min(F.struct((-F.round(F.col("score") + F.col("iou"), 9)).alias("inv"), "idx")).alias("x")
    return pair.groupBy("step_id", "prompt_idx").agg(best).select("step_id", "prompt_idx", "x.idx", (0.0 - F.col("x.inv")).alias("quality"))


def defect_summary(records: DataFrame, key: str = "step_id") -> DataFrame:
    """Mean severity and numbers of defects of records (status, verdict of severity, well_formed, note)."""
    bad = F.col("verdict.well_formed") == F.lit(False)

    def number(c: Column, name: str) -> Column:
        return F.count_if(F.coalesce(c, F.lit(False))).alias(name)

    return records.groupBy(key).agg(
        F.avg("verdict.severity").alias("mean_severity"),
        number(bad, "defective"),
        number(bad & (F.col("status") == "match"), "defective_matched"),
        number(bad & (F.col("status") == "hallucination"), "defective_extra"),
        number(F.col("verdict.note") == "vlm_unparsed", "unparsed"),
    )


def morphology(area_a: Column, aspect_a: Column, area_b: Column, aspect_b: Column, alpha: float = 0.5, beta: float = 0.5) -> Column:
    """How far b's area and aspect are from a's; null where a has no area, an empty b has aspect 0."""
    aspect = F.when(area_b > 0, aspect_b).otherwise(0.0)
    return F.when(area_a != 0, alpha * F.abs(1 - area_b / (area_a + 1e-6)) + beta * F.abs(aspect - aspect_a))
