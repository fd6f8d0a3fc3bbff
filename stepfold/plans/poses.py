"""Pose queries: relative motion, comparison, calibration, ground motion, validity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pose
from ..operators import fold, ground
from .fixtures import POSES_SQL, poses, table
from .registry import query, r9

W = f"WITH {POSES_SQL}"


def _hops(spark, d):
    """Source and target of each hop to the next pose of a step: one equi-join on the id."""
    p = poses(spark, d)
    cols = ["yaw", "pitch", "c0", "c1", "c2"]
    t = p.select(F.col("vec_id").alias("tv"), F.col("step_id").alias("ts"), *(F.col(c).alias(f"t_{c}") for c in cols))
    return p.join(t, (F.col("tv") == F.col("vec_id") + 1) & (F.col("ts") == F.col("step_id")))


def _motion():
    r0, r1 = pose.yaw_pitch(F.col("yaw"), F.col("pitch")), pose.yaw_pitch(F.col("t_yaw"), F.col("t_pitch"))
    return pose.relative_motion(r0, [F.col(f"c{k}") for k in range(3)], r1, [F.col(f"t_c{k}") for k in range(3)])


MOTION = ("tx", "ty", "tz", "translation_norm", "yaw", "pitch", "rotation_angle")


def _moved(spark, d):
    m = _motion()
    return _hops(spark, d).select("vec_id", "step_id", "action", "n0", "n1", "n2", *(m[k].alias(f"m_{k}") for k in MOTION))


@query("q41_relative_motion", f"{W} SELECT vec_id, " + ", ".join(f"round({k}, 7) AS {k}" for k in MOTION) + " FROM moved")
def relative_motion(spark, d):
    return _moved(spark, d).select("vec_id", *(F.round(f"m_{k}", 7).alias(k) for k in MOTION))


COMPARED_SQL = """cmp AS (SELECT *, tx + n0 AS qx, ty + n1 AS qy, tz + n2 AS qz, CASE action WHEN 'forward' THEN 'tz_forward_m' WHEN 'left' THEN 'tx_right_m' WHEN 'up' THEN 'ty_down_m' WHEN 'yaw_left' THEN 'yaw_deg' ELSE 'pitch_deg' END AS component,
   CASE WHEN action IN ('forward', 'left', 'up') THEN 'm' ELSE 'deg' END AS unit,
   CASE action WHEN 'forward' THEN tz WHEN 'left' THEN tx WHEN 'up' THEN ty WHEN 'yaw_left' THEN yaw ELSE pitch END AS expected,
   CASE action WHEN 'forward' THEN tz + n2 WHEN 'left' THEN tx + n0 WHEN 'up' THEN ty + n1 WHEN 'yaw_left' THEN yaw + 30 * n0 ELSE pitch + 30 * n1 END AS pred FROM moved),
 dirs AS (SELECT *, (tx * qx + ty * qy + tz * qz) / (translation_norm * sqrt(qx * qx + qy * qy + qz * qz)) AS dir_cos, abs(pred - expected) AS abs_err,
   CASE WHEN abs(expected) <= CASE unit WHEN 'm' THEN 1e-3 ELSE 1e-2 END THEN NULL WHEN abs(pred) <= CASE unit WHEN 'm' THEN 1e-3 ELSE 1e-2 END THEN 0.0::DOUBLE ELSE (sign(pred) = sign(expected))::INT::DOUBLE END AS sign_ok FROM cmp)"""


def _compared(spark, d):
    m = _moved(spark, d)
    want = {k: F.col(f"m_{k}") for k in MOTION}
    t, q = [want["tx"], want["ty"], want["tz"]], [want["tx"] + F.col("n0"), want["ty"] + F.col("n1"), want["tz"] + F.col("n2")]
    got = want | {"tx": q[0], "ty": q[1], "tz": q[2], "yaw": want["yaw"] + 30 * F.col("n0"), "pitch": want["pitch"] + 30 * F.col("n1")}
    a, b = pose.action_component(F.col("action"), want), pose.action_component(F.col("action"), got)
    m = m.select("vec_id", a["component"].alias("component"), a["unit"].alias("unit"), a["value"].alias("expected"), b["value"].alias("pred"), pose.cosine(t, q).alias("dir_cos"))
    return m.withColumns({"abs_err": F.abs(F.col("pred") - F.col("expected")), "sign_ok": pose.direction_correct(F.col("pred"), F.col("expected"), F.col("unit"))})


@query("q42_pose_compare", f"{W}, {COMPARED_SQL} SELECT vec_id, component, unit, round(expected, 7) AS expected, round(pred, 7) AS pred, round(abs_err, 7) AS abs_err, sign_ok, round(dir_cos, 7) AS dir_cos FROM dirs")
def pose_compare(spark, d):
    c = _compared(spark, d)
    return c.select("vec_id", "component", "unit", *(F.round(x, 7).alias(x) for x in ("expected", "pred", "abs_err", "dir_cos")), "sign_ok")


@query("q43_scale_calibration", f"{W} SELECT step_id, round(avg(translation_norm / sqrt((tx + n0) * (tx + n0) + (ty + n1) * (ty + n1) + (tz + n2) * (tz + n2))), 7) AS scale, count(*) AS n FROM moved GROUP BY 1")
def scale_calibration(spark, d):
    raw = pose.norm([F.col(f"m_{c}") + F.col(n) for c, n in (("tx", "n0"), ("ty", "n1"), ("tz", "n2"))])
    return _moved(spark, d).groupBy("step_id").agg(F.round(F.avg(F.col("m_translation_norm") / raw), 7).alias("scale"), F.count("*").alias("n"))


@query(
    "q44_ground_pose_delta",
    f"""{W}, g AS (SELECT vec_id, a2 / (sqrt(a2 * a2 + a5 * a5) + 1e-8::DOUBLE) AS ux, a5 / (sqrt(a2 * a2 + a5 * a5) + 1e-8::DOUBLE) AS uy, b2 / (sqrt(b2 * b2 + b5 * b5) + 1e-8::DOUBLE) AS wx, b5 / (sqrt(b2 * b2 + b5 * b5) + 1e-8::DOUBLE) AS wy,
      atan2(a8, sqrt(a2 * a2 + a5 * a5) + 1e-8::DOUBLE) AS p0, atan2(b8, sqrt(b2 * b2 + b5 * b5) + 1e-8::DOUBLE) AS p1, d0, d1, d2, sqrt(d0 * d0 + d1 * d1) AS dist FROM hop),
    s AS (SELECT *, CASE WHEN dist > 1e-6 THEN degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (ux * d0 + uy * d1) / (sqrt(ux * ux + uy * uy) * dist))))) * CASE WHEN ux * d1 - uy * d0 > 0 THEN -1 ELSE 1 END ELSE 0.0::DOUBLE END AS angle,
      degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (ux * wx + uy * wy) / (sqrt(ux * ux + uy * uy) * sqrt(wx * wx + wy * wy)))))) * CASE WHEN ux * wy - uy * wx > 0 THEN -1 ELSE 1 END AS dangle FROM g)
    SELECT vec_id, round(dist * sin(radians(angle)), 6) AS dx, round(dist * cos(radians(angle)), 6) AS dy, round(d2, 6) AS dz, round(dangle, 5) AS dangle, round(degrees(p1 - p0), 6) AS dphi FROM s""",
)
def ground_pose_delta(spark, d):
    h = _hops(spark, d)
    r0, r1 = pose.yaw_pitch(F.col("yaw"), F.col("pitch")), pose.yaw_pitch(F.col("t_yaw"), F.col("t_pitch"))
    g = pose.ground_delta([r0[2], r0[5], r0[8]], [F.col(f"c{k}") for k in range(3)], [r1[2], r1[5], r1[8]], [F.col(f"t_c{k}") for k in range(3)])
    return h.select("vec_id", *(F.round(v, 5 if k == "dangle" else 6).alias(k) for k, v in g.items()))


@query("q46_cosine01", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT a.vec_id, round((list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) + 1) / 2, 9) AS sim01 FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def cosine01(spark, d):
    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("k"), F.col("v").alias("w")), F.col("vec_id") == F.col("k"))
    return j.select("vec_id", r9((dot("v", "w") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("w", "w"))) + 1) / 2).alias("sim01"))


@query("q51_metric_summary", f"{W} SELECT count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(median({c}), 6) AS {c}_median, round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max" for c in ("translation_norm", "rotation_angle")) + " FROM moved")
def metric_summary(spark, d):
    m = _moved(spark, d).select(F.col("m_translation_norm").alias("translation_norm"), F.col("m_rotation_angle").alias("rotation_angle"))
    s = fold.summary(m, m.columns, direct=fold.is_small(spark, f"{d}/embeddings.parquet"))
    return s.select(F.col("translation_norm_count").alias("n"), *(F.round(f"{c}_{k}", 6).alias(f"{c}_{k}") for c in m.columns for k in ("mean", "median", "min", "max")))


@query("q52_pose_split_summary", f"""{W}, {COMPARED_SQL} SELECT CASE unit WHEN 'm' THEN 'translation' ELSE 'rotation' END AS grp, count(*) AS n, round(avg(abs_err), 7) AS abs_err_mean, round(median(abs_err), 7) AS abs_err_median,
    round(avg(dir_cos), 7) AS dir_cos_mean, round(avg(sign_ok), 7) AS sign_ok_rate FROM dirs GROUP BY 1""")
def pose_split_summary(spark, d):
    c = _compared(spark, d).withColumn("grp", F.when(F.col("unit") == "m", "translation").otherwise("rotation"))
    s = fold.summary(c, ["abs_err", "dir_cos", "sign_ok"], ["grp"], fold.is_small(spark, f"{d}/embeddings.parquet"))
    return s.select("grp", F.col("abs_err_count").alias("n"), *(F.round(a, 7).alias(b) for a, b in (("abs_err_mean", "abs_err_mean"), ("abs_err_median", "abs_err_median"), ("dir_cos_mean", "dir_cos_mean"), ("sign_ok_mean", "sign_ok_rate"))))


@query("q78_matrix_validity", f"""{W} SELECT vec_id, abs(r0 * (r4 * r8 - r5 * r7) - r1 * (r3 * r8 - r5 * r6) + r2 * (r3 * r7 - r4 * r6) - 1) < 1e-6 AND vec_id % 11 <> 0 AS valid,
    round(-(r0 * c0 + r3 * c1 + r6 * c2), 7) AS inv_x, round(-(r1 * c0 + r4 * c1 + r7 * c2), 7) AS inv_y, round(-(r2 * c0 + r5 * c1 + r8 * c2), 7) AS inv_z FROM rot""")
def matrix_validity(spark, d):
    r = pose.yaw_pitch(F.col("yaw"), F.col("pitch"))
    c = [F.col(f"c{k}") for k in range(3)]
    # a rigid inverse: the transposed rotation, and minus that times the position
    inv = [-(r[i] * c[0] + r[3 + i] * c[1] + r[6 + i] * c[2]) for i in range(3)]
    scaled = [x * F.when(F.col("vec_id") % 11 == 0, 2.0).otherwise(1.0) for x in r]
    ok = F.abs(pose.determinant(scaled) - 1) < 1e-6
    return poses(spark, d).select("vec_id", ok.alias("valid"), *(F.round(v, 7).alias(f"inv_{n}") for v, n in zip(inv, "xyz", strict=True)))


GROUND_SQL = f"""{W}, g AS (SELECT step_id, c0, c1, c2, r1, r4, r7 FROM rot),
    s AS (SELECT step_id, count(*) AS n, avg(r1) AS d0, avg(r4) AS d1, avg(r7) AS d2, var_pop(c0) AS a, covar_pop(c0, c1) AS b, covar_pop(c0, c2) AS c, var_pop(c1) AS d, covar_pop(c1, c2) AS e, var_pop(c2) AS f FROM g GROUP BY 1),
    m AS (SELECT *, (a + d + f) / 3 AS q, sqrt(((a - (a + d + f) / 3) ** 2 + (d - (a + d + f) / 3) ** 2 + (f - (a + d + f) / 3) ** 2 + 2 * (b * b + c * c + e * e)) / 6) AS p FROM s),
    h AS (SELECT *, acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c)) / nullif(p ** 3, 0)) / 2))) / 3 AS phi FROM m)
    SELECT step_id, n, round(q + 2 * p * cos(phi), 6) AS spread1, round(q + 2 * p * cos(phi + 4 * pi() / 3), 6) AS spread2, round(q + 2 * p * cos(phi + 2 * pi() / 3), 6) AS spread3,
      0.0::DOUBLE AS mixed, 0.0::DOUBLE AS centre, 1.0::DOUBLE AS handed, true AS level FROM h"""


@query("q127_ground_alignment", GROUND_SQL)
def ground_alignment(spark, d):
    """Of each step's aligned cameras: variances along the axes (the covariance's eigenvalues), no covariance, centred, right-handed, upright."""
    p = poses(spark, d)
    r, zero, one = pose.yaw_pitch(F.col("yaw"), F.col("pitch")), F.lit(0.0), F.lit(1.0)
    c = [F.col(f"c{k}") for k in range(3)]
    frames = p.select("step_id", F.array(*r[:3], c[0], *r[3:6], c[1], *r[6:], c[2], zero, zero, zero, one).alias("pose"))
    v = ground.aligned(frames, "step_id").select("step_id", *(F.col("pose")[k].alias(f"p{k}") for k in range(12)))
    x, y, z = F.col("p3"), F.col("p7"), F.col("p11")
    turn = [F.col(f"p{k}") for k in (0, 1, 2, 4, 5, 6, 8, 9, 10)]
    off = F.greatest(*(F.abs(F.covar_pop(a, b)) for a, b in ((x, y), (x, z), (y, z))))
    mid = F.greatest(*(F.abs(F.avg(a)) for a in (x, y, z)))
    return v.withColumn("det", pose.determinant(turn)).groupBy("step_id").agg(
        F.count("*").alias("n"),
        *(F.round(F.var_pop(a), 6).alias(f"spread{k}") for k, a in enumerate((x, y, z), 1)),
        F.round(off, 6).alias("mixed"),
        F.round(mid, 6).alias("centre"),
        F.round(F.avg("det"), 6).alias("handed"),
        (F.avg("p9") <= 1e-9).alias("level"),
    )
