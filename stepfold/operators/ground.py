"""Ground alignment of scenes from second moments: one aggregation a scene, principal axes by Jacobi rotations in Columns.

No scene is gathered anywhere: centres, covariances and the mean downward axis are
mergeable sums, the axes of a scene come from its dozen numbers, and each frame is
turned on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Three rotations are a sweep; symmetric 3x3 matrices settle to the last bit within six.
ROTATIONS = 18
_SHAPE = ("a00", "a01", "a02", "a11", "a12", "a22")
_AXES = [f"v{i}{j}" for i in range(3) for j in range(3)]


def _rotated(s: Column) -> Column:
    """One Jacobi rotation that clears a01, after which axes 0, 1, 2 are called 2, 0, 1."""
    a = {n: s[n] for n in _SHAPE}
    theta = (a["a11"] - a["a00"]) / (2 * a["a01"])
    t = F.when(a["a01"] == 0, 0.0).otherwise(F.when(theta < 0, -1.0).otherwise(1.0) / (F.abs(theta) + F.sqrt(theta * theta + 1)))
    # t, its cosine and its sine are read often, so they are made once
    def with_turn(r: Column) -> Column:
        c, n, t = r["c"], r["c"] * r["t"], r["t"]
        new = {"a00": a["a00"] - t * a["a01"], "a11": a["a11"] + t * a["a01"], "a01": F.lit(0.0), "a02": c * a["a02"] - n * a["a12"], "a12": n * a["a02"] + c * a["a12"], "a22": a["a22"]}
        turned = {"a00": new["a11"], "a01": new["a12"], "a02": new["a01"], "a11": new["a22"], "a12": new["a02"], "a22": new["a00"]}
        v = {}
        for i in range(3):
            x, y = s[f"v{i}0"], s[f"v{i}1"]
            v |= {f"v{i}2": c * x - n * y, f"v{i}0": n * x + c * y, f"v{i}1": s[f"v{i}2"]}
        return F.struct(*(turned[n].alias(n) for n in _SHAPE), *(v[n].alias(n) for n in _AXES))

    return F.get(F.transform(F.transform(F.array(t), lambda t: F.struct(t.alias("t"), (1 / F.sqrt(t * t + 1)).alias("c"))), with_turn), F.lit(0))


def principal_axes(shape: list[Column]) -> Column:
    """Of a symmetric matrix (six numbers by rows): an array of (value, axis), largest value first.

    An axis has length one, and its component of largest size (the first, if they tie) is positive.
    """
    start = F.struct(*(c.cast("double").alias(n) for c, n in zip(shape, _SHAPE, strict=True)), *(F.lit(float(n[1] == n[2])).alias(n) for n in _AXES))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROTATIONS)), start, lambda s, _: _rotated(s))

    def sign(v: Column) -> Column:
        most = F.array_max(F.transform(v, F.abs))
        first = F.get(F.filter(v, lambda x: F.abs(x) == most), F.lit(0))
        return F.transform(v, lambda x: F.when(first < 0, -x).otherwise(x))

    def ordered(s: Column) -> Column:
        each = F.array(*(F.struct(s[f"a{k}{k}"].alias("value"), F.array(*(s[f"v{i}{k}"] for i in range(3))).alias("axis")) for k in range(3)))
        return F.reverse(F.array_sort(each))

    axes = F.get(F.transform(F.array(done), ordered), F.lit(0))
    return F.transform(axes, lambda x: F.struct(x["value"].alias("value"), sign(x["axis"]).alias("axis")))


def alignments(frames: DataFrame, scene: str = "scene_id", pose: str = "pose") -> DataFrame:
    """scene, centre (array of 3), rows (the new axes, three arrays of 3), spread (their variances): one row a scene.

    The first two axes span the plane that the positions (poses are arrays of 16 by rows)
    spread over, the third points against the cameras' mean y axis; together they are right-handed.
    """
    p = F.col(pose)
    c, down = [p[k].cast("double") for k in (3, 7, 11)], [p[k].cast("double") for k in (1, 5, 9)]
    shape = [F.covar_pop(c[i], c[j]) for i in range(3) for j in range(i, 3)]
    sums = frames.filter(p.isNotNull()).groupBy(scene).agg(*(x.alias(n) for n, x in zip(_SHAPE, shape, strict=True)), F.array(*map(F.avg, c)).alias("centre"), F.array(*map(F.avg, down)).alias("down"))
    each = sums.withColumn("axes", principal_axes([F.col(n) for n in _SHAPE]))
    each = each.select(scene, "centre", "down", F.inline(F.array(F.struct(*(F.col("axes")[k]["axis"].alias(f"u{k}") for k in range(3)), F.transform("axes", lambda x: x["value"]).alias("spread")))))
    u2, d = F.col("u2"), F.col("down")
    level = u2[0] * d[0] + u2[1] * d[1] + u2[2] * d[2]
    each = each.withColumn("up", F.transform("u2", lambda x: F.when(level > 0, -x).otherwise(x)))
    a, b, z = F.col("u0"), F.col("u1"), F.col("up")
    det = a[0] * (b[1] * z[2] - b[2] * z[1]) - a[1] * (b[0] * z[2] - b[2] * z[0]) + a[2] * (b[0] * z[1] - b[1] * z[0])
    return each.select(scene, "centre", F.array("u0", F.transform("u1", lambda x: F.when(det < 0, -x).otherwise(x)), "up").alias("rows"), "spread")


def aligned(frames: DataFrame, scene: str = "scene_id", pose: str = "pose") -> DataFrame:
    """``frames`` with each pose turned to its scene's ground; a null pose stays null."""
    found = alignments(frames, scene, pose).withColumnRenamed(scene, "_scene")
    both = frames.join(found, F.col(scene).eqNullSafe(F.col("_scene")), "left")

    def turned(p: Column) -> Column:
        r, c = F.col("rows"), F.col("centre")
        cells = []
        for i in range(3):
            cells += [sum((r[i][k] * p[4 * k + j] for k in (1, 2)), r[i][0] * p[j]) for j in range(3)]
            cells.append(sum((r[i][k] * (p[4 * k + 3] - c[k]) for k in (1, 2)), r[i][0] * (p[3] - c[0])))
        return F.array(*cells, *(p[k].cast("double") for k in (12, 13, 14, 15)))

    return both.withColumn(pose, F.when(F.col(pose).isNotNull(), turned(F.col(pose)))).drop("_scene", "centre", "rows", "spread")
