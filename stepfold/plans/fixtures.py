"""Derived views over the host tables: step records, objects, poses and pair signals.

Each has a Spark definition and the same in DuckDB's SQL (as CTEs for oracles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.boxes import box

#: The class names that embedding labels 0 to 9 stand for.
CLASSES = ["chair", "stool", "table", "desk", "sofa", "bed", "tv", "monitor", "shelf", "bookshelf"]
HEIGHT, WIDTH, PER_STEP = 480.0, 640.0, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def step_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pose-like and object-like step records of lineitem; all windows and folds share the order key's partitioning."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    w = Window.partitionBy("l_orderkey")
    line = line.withColumn("step", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).withColumn("n", F.count("*").over(w))
    subtype = F.when(F.col("n") == 1, "atomic").when(F.col("n") == 2, "cycle").otherwise("chain")
    case = F.concat(F.lit("host__"), F.col("l_orderkey").cast("string"), F.lit("__"), F.col("subtype"))
    g, p = (F.col("l_partkey") % 7).cast("int"), (F.col("l_suppkey") % 9).cast("int")
    return line.withColumn("subtype", subtype).select(
        "l_orderkey",
        "step",
        "subtype",
        case.alias("case_id"),
        F.concat(case, F.lit("__step"), F.col("step").cast("string")).alias("id"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0).alias("action_sign_correct"),
        F.when(F.col("l_linestatus") == "O", "m").otherwise("deg").alias("action_unit"),
        (F.col("l_quantity") - 25).alias("action_expected"),
        (F.col("l_quantity") * F.col("l_discount")).alias("action_abs_err"),
        g.alias("num_gt_objects"),
        p.alias("num_pred_all"),
        F.least(g, p, F.col("l_quantity").cast("int") % 5).alias("num_matched"),
        (5 * F.col("l_tax")).alias("center_error_norm"),
        (1 - 4 * F.col("l_discount")).alias("object_integrity"),
        (10 * F.col("l_discount")).alias("relative_topology"),
    )


STEPS_SQL = """
base AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS step,
                count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
kinds AS (SELECT *, CASE n WHEN 1 THEN 'atomic' WHEN 2 THEN 'cycle' ELSE 'chain' END AS subtype FROM base),
steps AS (SELECT l_orderkey, step::INT AS step, subtype, 'host__' || l_orderkey || '__' || subtype AS case_id,
   'host__' || l_orderkey || '__' || subtype || '__step' || step AS id,
   CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS action_sign_correct,
   CASE WHEN l_linestatus = 'O' THEN 'm' ELSE 'deg' END AS action_unit,
   l_quantity - 25 AS action_expected, l_quantity * l_discount AS action_abs_err,
   (l_partkey % 7)::INT AS num_gt_objects, (l_suppkey % 9)::INT AS num_pred_all,
   least((l_partkey % 7)::INT, (l_suppkey % 9)::INT, l_quantity::INT % 5) AS num_matched,
   5 * l_tax AS center_error_norm, 1 - 4 * l_discount AS object_integrity, 10 * l_discount AS relative_topology FROM kinds),
scored AS (SELECT *, CASE WHEN action_sign_correct = 0 THEN 0.0::DOUBLE ELSE action_sign_correct * (1 + 1 / (1 + action_abs_err /
   greatest(abs(action_expected), CASE WHEN action_unit LIKE 'm%' THEN 0.1::DOUBLE ELSE 5.0::DOUBLE END))) / 2 END AS score FROM steps),
valid AS (SELECT * FROM steps WHERE l_orderkey NOT IN (SELECT l_orderkey FROM steps WHERE num_gt_objects <= 0)),
parts AS (SELECT *, num_matched::DOUBLE / num_gt_objects AS recall,
   CASE WHEN num_gt_objects + num_pred_all > 0 THEN 2.0::DOUBLE * num_matched / (num_gt_objects + num_pred_all) ELSE 0.0::DOUBLE END AS f1,
   CASE WHEN num_matched > 0 THEN num_matched::DOUBLE / num_gt_objects * greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - center_error_norm)) ELSE 0.0::DOUBLE END AS position,
   CASE WHEN num_matched > 0 THEN num_matched::DOUBLE / num_gt_objects * greatest(0.0::DOUBLE, least(1.0::DOUBLE, object_integrity)) ELSE 0.0::DOUBLE END AS integrity,
   greatest(0.0::DOUBLE, least(1.0::DOUBLE, relative_topology)) AS relative FROM valid),
components AS (SELECT *, CASE WHEN num_gt_objects >= 2 THEN (position + relative) / 2 ELSE position END AS spatial FROM parts)
"""


def _e(k: int):
    return F.element_at("e", k)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground-truth and predicted boxes and depths, ten objects a step."""
    df = vectors(spark, sf_dir)
    cx, cy, hw, hh = 320 + 400 * _e(1), 240 + 300 * _e(2), 20 + 100 * F.abs(_e(3)), 20 + 100 * F.abs(_e(4))
    px, py, pw, ph = cx + 120 * _e(5), cy + 120 * _e(6), 20 + 100 * F.abs(_e(7)), 20 + 100 * F.abs(_e(8))
    depth = 2 + 8 * F.abs(_e(9))
    name = F.element_at(F.array(*map(F.lit, CLASSES)), F.col("label") + 1)
    return df.select(
        F.floor(F.col("vec_id") / PER_STEP).alias("step_id"),
        (F.col("vec_id") % PER_STEP).cast("int").alias("idx"),
        (F.col("vec_id") % 5 != 0).alias("matched"),
        name.alias("label"),
        box(cx - hw, cy - hh, cx + hw, cy + hh).alias("gt"),
        box(px - pw, py - ph, px + pw, py + ph).alias("pred"),
        depth.alias("gt_depth"),
        (depth * (1 + _e(10))).alias("pred_depth"),
        F.slice("e", 33, 32).alias("feature"),
        F.abs(_e(25)).alias("score"),
    )


OBJECTS_SQL = f"""
raw AS (SELECT vec_id, label AS label_no, embedding::DOUBLE[] AS e FROM embeddings),
mid AS (SELECT vec_id, label_no, e, 320 + 400 * e[1] AS cx, 240 + 300 * e[2] AS cy, 20 + 100 * abs(e[3]) AS hw, 20 + 100 * abs(e[4]) AS hh,
   320 + 400 * e[1] + 120 * e[5] AS px, 240 + 300 * e[2] + 120 * e[6] AS py, 20 + 100 * abs(e[7]) AS pw, 20 + 100 * abs(e[8]) AS ph, 2 + 8 * abs(e[9]) AS gt_depth FROM raw),
objects AS (SELECT vec_id // 10 AS step_id, (vec_id % 10)::INT AS idx, vec_id % 5 <> 0 AS matched, {CLASSES!r}[label_no + 1] AS label,
   cx - hw AS gx1, cy - hh AS gy1, cx + hw AS gx2, cy + hh AS gy2, px - pw AS px1, py - ph AS py1, px + pw AS px2, py + ph AS py2,
   (cx - hw + (cx + hw)) * 0.5::DOUBLE AS gcx, (cy - hh + (cy + hh)) * 0.5::DOUBLE AS gcy, (px - pw + (px + pw)) * 0.5::DOUBLE AS pcx, (py - ph + (py + ph)) * 0.5::DOUBLE AS pcy,
   gt_depth, gt_depth * (1 + e[10]) AS pred_depth, e[33:64] AS feature, abs(e[25]) AS score FROM mid),
pairs AS (SELECT a.step_id, a, b FROM objects a JOIN objects b ON a.step_id = b.step_id AND a.idx < b.idx)
"""


def iou_sql(a: str, b: str, eps: float | None = None) -> str:
    """SQL of the intersection over union of the boxes with prefixes ``a`` and ``b`` (such as ``o.g``)."""
    inter = f"(greatest(0.0::DOUBLE, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0.0::DOUBLE, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))"
    size = "(greatest(0.0::DOUBLE, {0}x2 - {0}x1) * greatest(0.0::DOUBLE, {0}y2 - {0}y1))"
    union = f"({size.format(a)} + {size.format(b)} - {inter})"
    return f"({inter} / ({union} + {eps}::DOUBLE))" if eps else f"(CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0.0::DOUBLE END)"


ACTIONS = ["forward", "left", "up", "yaw_left", "pitch_up"]


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera poses: yaw, pitch, position, noise for a prediction, an action."""
    df = vectors(spark, sf_dir)
    return df.select(
        "vec_id",
        F.floor(F.col("vec_id") / PER_STEP).alias("step_id"),
        (2 * _e(11)).alias("yaw"),
        _e(12).alias("pitch"),
        *((4 * _e(13 + k)).alias(f"c{k}") for k in range(3)),
        *(_e(16 + k).alias(f"n{k}") for k in range(3)),
        F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("label") % 5 + 1).alias("action"),
    )


POSES_SQL = f"""
raw AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
poses AS (SELECT vec_id, vec_id // 10 AS step_id, 2 * e[11] AS yaw, e[12] AS pitch, 4 * e[13] AS c0, 4 * e[14] AS c1, 4 * e[15] AS c2, e[16] AS n0, e[17] AS n1, e[18] AS n2,
   {ACTIONS!r}[label % 5 + 1] AS action FROM raw),
rot AS (SELECT *, cos(yaw) AS r0, sin(yaw) * sin(pitch) AS r1, sin(yaw) * cos(pitch) AS r2, 0.0::DOUBLE AS r3, cos(pitch) AS r4, -sin(pitch) AS r5,
   -sin(yaw) AS r6, cos(yaw) * sin(pitch) AS r7, cos(yaw) * cos(pitch) AS r8 FROM poses),
hop AS (SELECT s.step_id, s.vec_id, s.action, s.n0, s.n1, s.n2, t.c0 - s.c0 AS d0, t.c1 - s.c1 AS d1, t.c2 - s.c2 AS d2,
   s.r0 AS a0, s.r1 AS a1, s.r2 AS a2, s.r3 AS a3, s.r4 AS a4, s.r5 AS a5, s.r6 AS a6, s.r7 AS a7, s.r8 AS a8,
   t.r0 AS b0, t.r1 AS b1, t.r2 AS b2, t.r3 AS b3, t.r4 AS b4, t.r5 AS b5, t.r6 AS b6, t.r7 AS b7, t.r8 AS b8,
   s.c0 AS s0, s.c1 AS s1, s.c2 AS s2, t.c0 AS t0, t.c1 AS t1, t.c2 AS t2
   FROM rot s JOIN rot t ON t.vec_id = s.vec_id + 1 AND t.step_id = s.step_id),
motion AS (SELECT *, a0 * d0 + a3 * d1 + a6 * d2 AS tx, a1 * d0 + a4 * d1 + a7 * d2 AS ty, a2 * d0 + a5 * d1 + a8 * d2 AS tz,
   a0 * b2 + a3 * b5 + a6 * b8 AS fx, a1 * b2 + a4 * b5 + a7 * b8 AS fy, a2 * b2 + a5 * b5 + a8 * b8 AS fz,
   (a0 * b0 + a3 * b3 + a6 * b6) + (a1 * b1 + a4 * b4 + a7 * b7) + (a2 * b2 + a5 * b5 + a8 * b8) AS trace FROM hop),
moved AS (SELECT *, sqrt(tx * tx + ty * ty + tz * tz) AS translation_norm, degrees(atan2(fx, fz)) AS yaw, degrees(atan2(fy, sqrt(fx * fx + fz * fz))) AS pitch,
   degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (trace - 1) / 2)))) AS rotation_angle FROM motion)
"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six pair signals; identity and shape are missing in places."""
    names = ["identity_sim", "struct_ssim", "edge_iou", "sharpness_ratio", "color_sim", "shape_sim"]
    cols = [F.least(F.lit(1.0), 2 * F.abs(_e(19 + k))) for k in range(6)]
    cols[0] = F.when(F.col("vec_id") % 7 != 0, cols[0])
    cols[5] = F.when(F.col("vec_id") % 3 != 0, cols[5])
    return vectors(spark, sf_dir).select("vec_id", *(c.alias(n) for c, n in zip(cols, names, strict=True)))


SIGNALS_SQL = """
raw AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
signals AS (SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN least(1.0::DOUBLE, 2 * abs(e[19])) END AS identity_sim, least(1.0::DOUBLE, 2 * abs(e[20])) AS struct_ssim,
   least(1.0::DOUBLE, 2 * abs(e[21])) AS edge_iou, least(1.0::DOUBLE, 2 * abs(e[22])) AS sharpness_ratio, least(1.0::DOUBLE, 2 * abs(e[23])) AS color_sim,
   CASE WHEN vec_id % 3 <> 0 THEN least(1.0::DOUBLE, 2 * abs(e[24])) END AS shape_sim FROM raw)
"""
