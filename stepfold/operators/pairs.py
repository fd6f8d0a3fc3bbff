"""Pairwise relation metrics over the objects of a step.

Pairs come from a self-join on the step with ``a.idx < b.idx``: an equi-join whose
groups are bounded by the number of detections per step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.scores import signed_gap


def pairs(objects: DataFrame, key: str = "step_id", idx: str = "idx") -> DataFrame:
    """Rows (key, a, b): structs of all columns of the two objects, each unordered pair once."""
    cols = [c for c in objects.columns if c != key]
    a = objects.select(key, F.struct(*cols).alias("a"))
    b = objects.select(key, F.struct(*cols).alias("b"))
    return a.join(b, key).filter(F.col(f"a.{idx}") < F.col(f"b.{idx}"))


def _vector(a: Column, b: Column) -> tuple[Column, Column]:
    return boxes.center_x(a) - boxes.center_x(b), boxes.center_y(a) - boxes.center_y(b)


def _norm(v: tuple[Column, Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1])


def relative_topology(objects: DataFrame, gap: float = 0.03, eps: float = 1e-8) -> DataFrame:
    """Planar and depth order of ground-truth pairs, as the prediction keeps them.

    ``objects`` has step_id, idx, matched, gt, pred (boxes), gt_depth, pred_depth.
    """
    p = pairs(objects)
    a, b = F.col("a"), F.col("b")
    both = a["matched"] & b["matched"]
    g, v = _vector(a["gt"], b["gt"]), _vector(a["pred"], b["pred"])
    cos = (g[0] * v[0] + g[1] * v[1]) / (_norm(g) * _norm(v))
    planar = F.when(both & (_norm(v) >= eps), boxes.clip01(cos)).otherwise(0.0)
    gt_gap, pred_gap = signed_gap(a["gt_depth"], b["gt_depth"]), signed_gap(a["pred_depth"], b["pred_depth"])
    eligible = F.coalesce(F.abs(gt_gap) > gap, F.lit(False))
    valid = eligible & both & pred_gap.isNotNull()
    tie = valid & (F.abs(pred_gap) <= gap)
    right = valid & ~tie & (gt_gap * pred_gap > 0)
    p = p.select("step_id", both.alias("both"), planar.alias("planar"), eligible.alias("eligible"), valid.alias("valid"), tie.alias("tie"), right.alias("right"))
    one = F.when(F.col("eligible"), (F.col("planar") + F.col("right").cast("double")) / 2).otherwise(F.col("planar"))
    n, e = F.count("*"), F.count_if("eligible")
    return p.groupBy("step_id").agg(
        F.avg("planar").alias("planar_all"),
        F.avg(F.when(F.col("both"), F.col("planar"))).alias("planar_matched"),
        F.try_divide(F.count_if("right"), e).alias("depth_all"),
        F.try_divide(F.count_if("right"), F.count_if("valid")).alias("depth_valid"),
        F.avg(one).alias("relative_all"),
        (F.count_if("both") / n).alias("pair_coverage"),
        (e / n).alias("eligibility"),
        e.alias("num_eligible"),
        F.count_if("valid").alias("num_valid"),
        F.count_if("right").alias("num_correct"),
        F.count_if("tie").alias("num_ties"),
    )


def legacy_topology(objects: DataFrame) -> DataFrame:
    """Direction times distance ratio of each pair; 0 for unmatched pairs, 1 for degenerate ones."""
    p = pairs(objects)
    a, b = F.col("a"), F.col("b")
    both = a["matched"] & b["matched"]
    g, v = _vector(a["gt"], b["gt"]), _vector(a["pred"], b["pred"])
    cos = (g[0] * v[0] + g[1] * v[1]) / (_norm(g) * _norm(v) + 1e-8)
    ratio = _norm(v) / (_norm(g) + 1e-8)
    score = F.greatest(F.lit(0.0), cos) * F.least(ratio, 1 / (ratio + 1e-8))
    score = F.when(~both, 0.0).when((_norm(g) < 1e-6) | (_norm(v) < 1e-6), 1.0).otherwise(score)
    p = p.select("step_id", both.alias("both"), score.alias("score"))
    return p.groupBy("step_id").agg(F.avg("score").alias("topology"), F.count("*").alias("num_pairs"), F.count_if("both").alias("matched_pairs"), F.count_if(F.col("score") > 0).alias("positive_pairs"), (F.count_if("both") / F.count("*")).alias("coverage"))


def matched_layout(objects: DataFrame, tie: float = 0.03) -> DataFrame:
    """Area ratios of matched objects and, over their pairs, axis order and area ratios."""
    objects = objects.filter("matched")
    rounded = [boxes.area(boxes.box(*(F.bround(F.col(f"{s}.{c}"), 0) for c in ("x1", "y1", "x2", "y2")))) for s in ("gt", "pred")]
    objects = objects.withColumn("ga", F.greatest(rounded[0], F.lit(1.0))).withColumn("pa", F.greatest(rounded[1], F.lit(1.0)))

    def fold(r):
        return F.least(r, 1 / F.greatest(r, F.lit(1e-6)))

    ratio = F.col("pa") / F.col("ga")
    single = objects.groupBy("step_id").agg(F.avg(ratio).alias("area_ratio"), F.avg(fold(ratio)).alias("area_score"))
    a, b = F.col("a"), F.col("b")
    g, v = _vector(a["gt"], b["gt"]), _vector(a["pred"], b["pred"])
    axes = []
    for k, mid in enumerate((boxes.center_x, boxes.center_y)):
        scale = F.greatest(F.lit(1.0), F.abs(mid(a["gt"])) + F.abs(mid(b["gt"])))
        used = (F.abs(g[k]) / scale >= tie) & (F.abs(v[k]) / scale >= tie)
        axes.append(F.when(used, (F.signum(g[k]) == F.signum(v[k])).cast("double")))
    location = F.try_divide(F.coalesce(axes[0], F.lit(0.0)) + F.coalesce(axes[1], F.lit(0.0)), axes[0].isNotNull().cast("int") + axes[1].isNotNull().cast("int"))
    rel = (a["pa"] / b["pa"]) / F.greatest(a["ga"] / b["ga"], F.lit(1e-6))
    double = pairs(objects).select("step_id", location.alias("loc"), fold(rel).alias("rel")).groupBy("step_id").agg(F.avg("loc").alias("location"), F.count("loc").alias("location_pairs"), F.avg("rel").alias("pair_area_score"))
    return single.join(double, "step_id", "left").fillna(0, ["location_pairs"])


def depth_order(objects: DataFrame, tie: float = 0.03) -> DataFrame:
    """Accuracy and tau of depth order over matched pairs; pairs within the absolute tie are skipped."""
    p = pairs(objects.filter("matched AND gt_depth IS NOT NULL AND pred_depth IS NOT NULL").select("step_id", "idx", "gt_depth", "pred_depth"))
    g, v = F.col("a.gt_depth") - F.col("b.gt_depth"), F.col("a.pred_depth") - F.col("b.pred_depth")
    skip = (F.abs(g) < tie) | (F.abs(v) < tie)
    p = p.select("step_id", skip.alias("skip"), (~skip & (g * v > 0)).alias("same"))
    used, same = F.count_if(~F.col("skip")), F.count_if("same")
    return p.groupBy("step_id").agg(F.try_divide(same, used).alias("accuracy"), F.try_divide(2 * same - used, used).alias("tau"), used.alias("num_pairs"), F.count_if("skip").alias("skipped"))
