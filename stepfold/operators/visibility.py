"""Points of a view carried to another as rows keyed by pixel: projection, z-buffer, dilation and closing.

A row of ``views`` is one image pair: id, depth (array of doubles, row by row), width,
mask (array of booleans as long, or null for all usable depths), k and to_k (nine numbers
each), pose and to_pose (sixteen each, last row 0 0 0 1), to_width, to_height.  Everything
after the first explode is keyed by (id, x, y) and dealt by id once; the neighbourhood steps add no
shuffle.  An id's rows are bounded by its image (``MOST`` points go through the projection).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reproject import FAR, LEAST, MOST, NEAR, SCALES

Matrix = list[Column]


def _cofactors(m: Matrix) -> Matrix:
    """The adjugate of a 3x3 matrix, and its determinant (null for 0)."""
    a, b, c, d, e, f, g, h, i = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d, F.when(det != 0, det)]


def _times(a: Matrix, b: Matrix) -> Matrix:
    n = len(b) // 3
    return [a[3 * r] * b[c] + a[3 * r + 1] * b[n + c] + a[3 * r + 2] * b[2 * n + c] for r in range(3) for c in range(n)]


def _of(name: str, n: int) -> Matrix:
    return [F.col(f"{name}_{i}") for i in range(n)]


def _stage(each: DataFrame, **made: Matrix) -> DataFrame:
    """Numbers name_0, name_1 ... of each matrix, by a generator, so that they are computed once and not written out again in each use."""
    return each.select("*", F.inline(F.array(F.struct(*(x.alias(f"{n}_{i}") for n, m in made.items() for i, x in enumerate(m))))))


TURN, MOVE = [0, 1, 2, 4, 5, 6, 8, 9, 10], [3, 7, 11]


def candidates(views: DataFrame) -> DataFrame:
    """``views`` six times: for each scale of the intrinsics and direction of the poses the matrix a_0 to a_8 and shift b_0 to b_2 that take (x, y, 1) z to the target."""
    tries = F.array(*(F.struct(F.lit(2 * i + j).alias("candidate"), F.lit(s).alias("scale"), F.lit(j == 0).alias("to_world")) for i, s in enumerate(SCALES) for j in (0, 1)))
    each = views.select("*", F.inline(tries))
    scaled = {n: [F.col(n)[i] * (F.col("scale") if i in (0, 2, 4, 5) else 1.0) for i in range(9)] for n in ("k", "to_k")}
    each = _stage(each, own=scaled["k"], there=scaled["to_k"], **{f"{n}_{part}": [F.col(n)[i] for i in at] for n in ("pose", "to_pose") for part, at in (("r", TURN), ("t", MOVE))})
    each = _stage(each, **{f"{n}_c": _cofactors(_of(m, 9)) for n, m in (("own", "own"), ("pose", "pose_r"), ("to_pose", "to_pose_r"))})
    each = _stage(each, **{f"{n}_i": [x / F.col(f"{n}_c_9") for x in _of(f"{n}_c", 9)] for n in ("own", "pose", "to_pose")})
    each = _stage(each, **{f"{n}_b": [-x for x in _times(_of(f"{n}_i", 9), _of(f"{n}_t", 3))] for n in ("pose", "to_pose")})
    # poses seen as maps from camera to world, or the other way round: the way in takes the view's points to the world, the way out to the target
    made = {}
    for name, way, first, second in (("pose", "in", ("r", "t"), ("i", "b")), ("to_pose", "out", ("i", "b"), ("r", "t"))):
        for part, n, x, y in zip(("turn", "move"), (9, 3), first, second, strict=True):
            made[f"{way}_{part}"] = [F.when(F.col("to_world"), u).otherwise(v) for u, v in zip(_of(f"{name}_{x}", n), _of(f"{name}_{y}", n), strict=True)]
    each = _stage(each, **made)
    move = [x + y for x, y in zip(_times(_of("out_turn", 9), _of("in_move", 3)), _of("out_move", 3), strict=True)]
    each = _stage(each, turn=_times(_of("out_turn", 9), _of("in_turn", 9)), move=move)
    each = _stage(each, near=_times(_of("turn", 9), _of("own_i", 9)))
    each = _stage(each, a=_times(_of("there", 9), _of("near", 9)), b=_times(_of("there", 9), _of("move", 3)))
    return each.select(*views.columns, "candidate", *_of("a", 9), *_of("b", 3))


def hits(views: DataFrame) -> DataFrame:
    """id, candidate, u, v, depth, rank and the target's size: the points of each candidate that fall inside."""
    masked = F.transform("depth", lambda z, i: F.struct((i % F.col("width")).cast("int").alias("x"), F.floor(i / F.col("width")).cast("int").alias("y"), z.cast("double").alias("z")))
    rows = views.withColumn("pixels", masked)
    usable = f"p.z > {NEAR} AND p.z < {FAR} AND NOT isnan(p.z)"
    rows = rows.withColumn("many", F.expr(f"CASE WHEN mask IS NULL THEN size(filter(pixels, p -> {usable})) ELSE size(filter(mask, m -> m)) END"))
    rows = rows.withColumn("points", F.expr(f"filter(pixels, (p, i) -> coalesce(mask[i], true) AND {usable})")).filter(F.col("many") >= LEAST)
    step = f"cast(size(points) - 1 AS double) / {MOST - 1}"
    thin = F.expr(f"transform(sequence(0, {MOST - 1}), k -> points[cast(floor(k * {step}) AS int)])")
    rows = rows.withColumn("points", F.when(F.size("points") > MOST, thin).otherwise(F.col("points")))
    each = candidates(rows.drop("depth", "mask", "pixels", "many"))
    each = each.select("id", "candidate", "to_width", "to_height", *_of("a", 9), *_of("b", 3), F.posexplode("points").alias("rank", "p"))

    def q(r: int) -> Column:
        a, b = _of("a", 9), _of("b", 3)
        return (a[3 * r] * F.col("p.x") + a[3 * r + 1] * F.col("p.y") + a[3 * r + 2]) * F.col("p.z") + b[r]

    each = each.select("id", "candidate", "to_width", "to_height", "rank", q(0).alias("q0"), q(1).alias("q1"), q(2).alias("far")).filter("far > 1e-4")
    each = each.withColumns({"uu": F.col("q0") / (F.col("far") + 1e-6), "vv": F.col("q1") / (F.col("far") + 1e-6)})
    inside = (F.col("uu") >= 0) & (F.col("vv") >= 0) & (F.col("uu") < F.col("to_width")) & (F.col("vv") < F.col("to_height"))
    return each.filter(inside).select("id", "candidate", "to_width", "to_height", F.floor("uu").cast("int").alias("x"), F.floor("vv").cast("int").alias("y"), F.col("far").alias("depth"), "rank")


def z_buffer(views: DataFrame) -> DataFrame:
    """id, candidate, n_inside, x, y, depth, rank, to_width, to_height: what is nearest at each pixel, by the first candidate with the most points inside.

    Ids with fewer than ``LEAST`` points inside have no rows.
    """
    found = hits(views)
    counts = found.groupBy("id", "candidate").agg(F.count("*").alias("n"))
    best = counts.groupBy("id").agg(F.max(F.struct("n", (-F.col("candidate")).alias("c"))).alias("best")).filter(F.col("best.n") >= LEAST)
    best = best.select("id", (-F.col("best.c")).alias("candidate"), F.col("best.n").alias("n_inside"))
    nearest = found.join(best, ["id", "candidate"]).repartition("id").groupBy("id", "candidate", "n_inside", "to_width", "to_height", "x", "y")
    return nearest.agg(F.min("depth").alias("depth"), F.min_by("rank", F.struct("depth", "rank")).alias("rank"))


def _around(pixels: DataFrame, radius: int) -> DataFrame:
    offset = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    near = pixels.select("id", "to_width", "to_height", F.col("x").alias("x0"), F.col("y").alias("y0"), offset.alias("dx")).select("*", offset.alias("dy"))
    near = near.select("id", "to_width", "to_height", (F.col("x0") + F.col("dx")).alias("x"), (F.col("y0") + F.col("dy")).alias("y"))
    return near.filter("x >= 0 AND y >= 0 AND x < to_width AND y < to_height").groupBy("id", "to_width", "to_height", "x", "y").agg(F.count("*").alias("n"))


def dilated(pixels: DataFrame, radius: int = 1) -> DataFrame:
    """Set pixels (id, to_width, to_height, x, y) and all within ``radius`` of them in the image."""
    return _around(pixels, radius).drop("n")


def eroded(pixels: DataFrame, radius: int = 1) -> DataFrame:
    """Pixels whose neighbours within the image are all set (each once in ``pixels``)."""
    wide, high = (f"(least({n} - 1, {c} + {radius}) - greatest(0, {c} - {radius}) + 1)" for n, c in (("to_width", "x"), ("to_height", "y")))
    return _around(pixels, radius).filter(f"n = {wide} * {high}").drop("n")


def closed(pixels: DataFrame, radius: int = 1) -> DataFrame:
    return eroded(dilated(pixels, radius), radius)


def carried(views: DataFrame) -> DataFrame:
    """id, to_width, to_height, x, y: each view's mask in its target, gaps closed."""
    return closed(dilated(z_buffer(views).select("id", "to_width", "to_height", "x", "y")), 2)


def support(views: DataFrame, target: str, radius: int = 3) -> DataFrame:
    """What all views of a ``target`` (a column of ``views``) support together, with ``target`` as id."""
    of = views.select("id", F.col(target).alias("of")).distinct()
    both = carried(views).join(of, "id").select(F.col("of").alias("id"), "to_width", "to_height", "x", "y").distinct()
    return closed(dilated(both.repartition("id"), radius), radius)


def visible_share(masks: DataFrame, supported: DataFrame) -> DataFrame:
    """id, object_id, area, share: of each object's pixels (id, object_id, x, y, each once) those that are supported."""
    seen = masks.join(supported.select("id", "x", "y", F.lit(1).alias("seen")), ["id", "x", "y"], "left")
    return seen.groupBy("id", "object_id").agg(F.count("*").alias("area"), (F.count("seen") / F.count("*")).alias("share"))
