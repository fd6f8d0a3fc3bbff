"""Queries over image-like grids: the 64 components of an embedding are an image of 8 x 8 pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import outlines, pictures, visibility
from .fixtures import table, vectors
from .registry import query, r9

SIDE, FOCAL = 8, 8.0

#: Six projections of every usable pixel of a view into the next camera, the best of them, its pixels closed over gaps.
CARRIED_SQL = """
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
pix AS (SELECT id, i % 8 AS x, i // 8 AS y, CASE WHEN e[i + 1] < -0.15 THEN 0 ELSE 2 + 8 * e[i + 1] END AS z, e[11] AS a, e[16] AS b, 2 * e[13] AS t0, 2 * e[14] AS t1, 2 * e[15] AS t2, 2 * e[17] AS u0, 2 * e[18] AS u1, 2 * e[19] AS u2
        FROM v, (SELECT unnest(range(64)) AS i)),
good AS (SELECT * FROM pix WHERE z > 0.05 AND z < 20),
enough AS (SELECT id FROM good GROUP BY id HAVING count(*) >= 10),
tries AS (SELECT 2 * i + j AS candidate, [1.0::DOUBLE, 2.0::DOUBLE, 0.5::DOUBLE][i + 1] AS s, j = 0 AS world FROM (SELECT unnest(range(3)) AS i), (SELECT unnest(range(2)) AS j)),
own AS (SELECT id, candidate, s, world, z, a, b, t0, t1, t2, u0, u1, u2, (x - 4 * s) / (8 * s) * z AS px, (y - 4 * s) / (8 * s) * z AS py, z AS pz FROM good JOIN enough USING (id), tries),
mid AS (SELECT *, CASE WHEN world THEN cos(a) * px + sin(a) * pz + t0 ELSE cos(a) * (px - t0) - sin(a) * (pz - t2) END AS wx,
               CASE WHEN world THEN py + t1 ELSE py - t1 END AS wy,
               CASE WHEN world THEN -sin(a) * px + cos(a) * pz + t2 ELSE sin(a) * (px - t0) + cos(a) * (pz - t2) END AS wz FROM own),
far AS (SELECT *, CASE WHEN world THEN cos(b) * (wx - u0) - sin(b) * (wz - u2) ELSE cos(b) * wx + sin(b) * wz + u0 END AS cx,
               CASE WHEN world THEN wy - u1 ELSE wy + u1 END AS cy,
               CASE WHEN world THEN sin(b) * (wx - u0) + cos(b) * (wz - u2) ELSE -sin(b) * wx + cos(b) * wz + u2 END AS cz FROM mid),
hit AS (SELECT id, candidate, cz, (8 * s * cx + 4 * s * cz) / (cz + 1e-6) AS uu, (8 * s * cy + 4 * s * cz) / (cz + 1e-6) AS vv FROM far WHERE cz > 1e-4),
ins AS (SELECT id, candidate, cz, floor(uu)::INT AS x, floor(vv)::INT AS y FROM hit WHERE uu >= 0 AND vv >= 0 AND uu < 8 AND vv < 8),
num AS (SELECT id, candidate, count(*) AS n FROM ins GROUP BY ALL),
best AS (SELECT id, candidate, n FROM num QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, candidate) = 1 AND n >= 10),
zbuf AS (SELECT id, candidate, n, x, y, min(cz) AS depth FROM ins JOIN best USING (id, candidate) GROUP BY ALL),
g AS (SELECT x::INT AS x, y::INT AS y FROM (SELECT unnest(range(8)) AS x), (SELECT unnest(range(8)) AS y)),
d1 AS (SELECT DISTINCT id, g.x, g.y FROM zbuf z JOIN g ON abs(g.x - z.x) <= 1 AND abs(g.y - z.y) <= 1),
d2 AS (SELECT DISTINCT id, g.x, g.y FROM d1 z JOIN g ON abs(g.x - z.x) <= 2 AND abs(g.y - z.y) <= 2),
shut AS (SELECT id, g.x, g.y FROM d2 z JOIN g ON abs(g.x - z.x) <= 2 AND abs(g.y - z.y) <= 2 GROUP BY ALL
         HAVING count(*) = (least(7, g.x + 2) - greatest(0, g.x - 2) + 1) * (least(7, g.y + 2) - greatest(0, g.y - 2) + 1))"""


def _views(spark, d):
    """Each embedding as a view into a second camera; both turn about y and have their own places."""
    e, zero, one = vectors(spark, d), F.lit(0.0), F.lit(1.0)

    def at(k):
        return F.element_at("e", k)

    def pose(angle, t):
        c, s = F.cos(angle), F.sin(angle)
        return F.array(c, zero, s, t[0], zero, one, zero, t[1], -s, zero, c, t[2], zero, zero, zero, one)

    k = F.array(*(F.lit(x) for x in (FOCAL, 0.0, SIDE / 2, 0.0, FOCAL, SIDE / 2, 0.0, 0.0, 1.0)))
    depth = F.transform("e", lambda x: F.when(x < -0.15, 0.0).otherwise(2 + 8 * x))
    return e.select(
        F.col("vec_id").alias("id"),
        depth.alias("depth"),
        F.lit(SIDE).alias("width"),
        F.lit(None).cast("array<boolean>").alias("mask"),
        k.alias("k"),
        k.alias("to_k"),
        pose(at(11), [2 * at(n) for n in (13, 14, 15)]).alias("pose"),
        pose(at(16), [2 * at(n) for n in (17, 18, 19)]).alias("to_pose"),
        F.lit(SIDE).alias("to_width"),
        F.lit(SIDE).alias("to_height"),
        F.floor(F.col("vec_id") / 4).alias("target"),
    )


@query(
    "q124_z_buffer",
    f"WITH {CARRIED_SQL} SELECT id AS vec_id, candidate, n AS n_inside, count(*) AS n_pixels, round(avg(depth), 6) AS mean_depth, sum(x * y)::BIGINT AS place FROM zbuf GROUP BY ALL",
)
def nearest_points(spark, d):
    z = visibility.z_buffer(_views(spark, d)).groupBy("id", "candidate", "n_inside")
    return z.agg(F.count("*").alias("n_pixels"), F.round(F.avg("depth"), 6).alias("mean_depth"), F.sum((F.col("x") * F.col("y")).cast("bigint")).alias("place")).withColumnRenamed("id", "vec_id")


@query("q125_carried_masks", f"WITH {CARRIED_SQL} SELECT id AS vec_id, count(*) AS area, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM shut GROUP BY 1")
def carried_masks(spark, d):
    seen = visibility.carried(_views(spark, d))
    return seen.groupBy(F.col("id").alias("vec_id")).agg(F.count("*").alias("area"), F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))


@query(
    "q126_visible_objects",
    f"""WITH {CARRIED_SQL}, wide AS (SELECT DISTINCT id // 4 AS id, x, y FROM shut),
    e1 AS (SELECT DISTINCT id, g.x, g.y FROM wide z JOIN g ON abs(g.x - z.x) <= 1 AND abs(g.y - z.y) <= 1),
    e2 AS (SELECT DISTINCT id, g.x, g.y FROM e1 z JOIN g ON abs(g.x - z.x) <= 1 AND abs(g.y - z.y) <= 1),
    seen AS (SELECT id, g.x, g.y FROM e2 z JOIN g ON abs(g.x - z.x) <= 1 AND abs(g.y - z.y) <= 1 GROUP BY ALL
             HAVING count(*) = (least(7, g.x + 1) - greatest(0, g.x - 1) + 1) * (least(7, g.y + 1) - greatest(0, g.y - 1) + 1)),
    obj AS (SELECT id // 4 AS step, id AS object_id, i % 8 AS x, i // 8 AS y FROM v, (SELECT unnest(range(64)) AS i) WHERE e[i + 1] > 0.1)
    SELECT step, object_id, count(*) AS area, round(count(s.x) / count(*)::DOUBLE, 9) AS share, count(s.x) / count(*)::DOUBLE >= 0.25 AS visible
    FROM obj o LEFT JOIN seen s ON s.id = o.step AND s.x = o.x AND s.y = o.y GROUP BY ALL""",
)
def visible_objects(spark, d):
    """Objects (bright pixels of a view) by the share that a step's four views support together."""
    objects = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "e")).filter("e > 0.1")
    objects = objects.select(F.floor(F.col("vec_id") / 4).alias("id"), F.col("vec_id").alias("object_id"), (F.col("i") % SIDE).alias("x"), F.floor(F.col("i") / SIDE).cast("int").alias("y"))
    share = visibility.visible_share(objects, visibility.support(_views(spark, d), "target", 1))
    return share.select(F.col("id").alias("step"), "object_id", "area", F.round("share", 9).alias("share"), (F.col("share") >= 0.25).alias("visible"))


#: Gray images of whole numbers, and each with its successor's.
IMAGE_SQL = """
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
pix AS (SELECT id, i % 8 AS x, i // 8 AS y, greatest(0.0::DOUBLE, least(255.0::DOUBLE, floor(128 + 500 * e[i + 1]))) AS v,
        greatest(0.0::DOUBLE, least(255.0::DOUBLE, floor(128 + 500 * e[(i + 21) % 64 + 1]))) AS g, greatest(0.0::DOUBLE, least(255.0::DOUBLE, floor(128 + 500 * e[(i + 42) % 64 + 1]))) AS b
        FROM v, (SELECT unnest(range(64)) AS i)),
two AS (SELECT p.id, x, y, p.v AS a, q.v AS b FROM pix p JOIN (SELECT id - 1 AS id, x, y, v FROM pix) q USING (id, x, y))"""


def _pixels(spark, d):
    """id, x, y, v, g, b of each embedding as an image of three planes."""
    each = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e")).select("id", "e", F.posexplode("e").alias("i", "v"))

    def level(v):
        return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(128 + 500 * v).cast("double")))

    return each.select(
        "id",
        (F.col("i") % SIDE).alias("x"),
        F.floor(F.col("i") / SIDE).cast("int").alias("y"),
        level(F.col("v")).alias("v"),
        *(level(F.get("e", (F.col("i") + k) % 64)).alias(n) for n, k in (("g", 21), ("b", 42))),
    )


def _before(pixels):
    """Images under the number of the one before."""
    return pixels.withColumn("id", F.col("id") - 1)


@query(
    "q128_structural_similarity",
    f"""WITH {IMAGE_SQL}, k AS (SELECT t, CASE WHEN t + o < 0 THEN -(t + o) WHEN t + o > 7 THEN 14 - (t + o) ELSE t + o END AS s, exp(-o * o / 4.5::DOUBLE) AS w FROM (SELECT unnest(range(8)) AS t), (SELECT unnest(range(-3, 4)) AS o)),
    w AS (SELECT t, s, sum(w) / (SELECT sum(exp(-o * o / 4.5::DOUBLE)) FROM (SELECT unnest(range(-3, 4)) AS o)) AS w FROM k GROUP BY ALL),
    m AS (SELECT id, wx.t AS x, wy.t AS y, sum(a * wx.w * wy.w) AS a, sum(b * wx.w * wy.w) AS b, sum(a * a * wx.w * wy.w) AS aa, sum(b * b * wx.w * wy.w) AS bb, sum(a * b * wx.w * wy.w) AS ab
          FROM two JOIN w wx ON wx.s = x JOIN w wy ON wy.s = y GROUP BY ALL)
    SELECT id AS vec_id, round(avg((2 * a * b + 6.5025::DOUBLE) * (2 * (ab - a * b) + 58.5225::DOUBLE) / ((a * a + b * b + 6.5025::DOUBLE) * (aa - a * a + bb - b * b + 58.5225::DOUBLE))), 6) AS ssim FROM m GROUP BY 1""",
)
def structural_similarity(spark, d):
    p = _pixels(spark, d)
    two = p.select("id", "x", "y", F.col("v").alias("a")).join(_before(p).select("id", "x", "y", F.col("v").alias("b")), ["id", "x", "y"])
    return pictures.ssim(two, (SIDE, SIDE)).select(F.col("id").alias("vec_id"), F.round("ssim", 6).alias("ssim"))


@query(
    "q129_resampled_images",
    f"""WITH {IMAGE_SQL}, area AS (SELECT t, s, (least((t + 1) * 8 / 3::DOUBLE, s + 1) - greatest(t * 8 / 3::DOUBLE, s)) / (8 / 3::DOUBLE) AS w FROM (SELECT unnest(range(3)) AS t), (SELECT unnest(range(8)) AS s)),
    a AS (SELECT id, wx.t AS x, wy.t AS y, sum(v * wx.w * wy.w) AS v FROM pix JOIN area wx ON wx.s = x AND wx.w > 0 JOIN area wy ON wy.s = y AND wy.w > 0 GROUP BY ALL),
    line AS (SELECT t, (t + 0.5::DOUBLE) * 8 / 5 - 0.5::DOUBLE AS p FROM (SELECT unnest(range(5)) AS t)),
    lin AS (SELECT t, least(7, greatest(0, floor(p)::INT + k)) AS s, sum(CASE k WHEN 0 THEN 1 - (p - floor(p)) ELSE p - floor(p) END) AS w FROM line, (SELECT unnest(range(2)) AS k) GROUP BY ALL),
    b AS (SELECT id, wx.t AS x, wy.t AS y, sum(v * wx.w * wy.w) AS v FROM pix JOIN lin wx ON wx.s = x JOIN lin wy ON wy.s = y GROUP BY ALL)
    SELECT 'area' AS kind, id AS vec_id, x, y, round(v, 6) AS value FROM a UNION ALL SELECT 'bilinear', id, x, y, round(v, 6) FROM b""",
)
def resampled_images(spark, d):
    p = _pixels(spark, d).select("id", "x", "y", F.col("v").alias("value"))

    def small(kind, n):
        return pictures.resized(p, (SIDE, SIDE), (n, n), kind).select(F.lit(kind).alias("kind"), F.col("id").alias("vec_id"), F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), F.round("value", 6).alias("value"))

    return small("area", 3).union(small("bilinear", 5))


@query(
    "q130_colour_similarity",
    f"""WITH {IMAGE_SQL}, c AS (SELECT id, v AS r, g, b, greatest(v, g, b) AS hi, greatest(v, g, b) - least(v, g, b) AS d FROM pix),
    t AS (SELECT *, CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN hi = r THEN CASE WHEN g < b THEN ((g - b) / d) % 6 + 6 ELSE (g - b) / d % 6 END WHEN hi = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END / 6 AS hue, CASE WHEN hi > 0 THEN d / hi ELSE 0.0::DOUBLE END AS sat FROM c),
    h AS (SELECT id, (least(floor((hue % 1) * 30), 29) * 32 + least(floor(sat / 1.0000001::DOUBLE * 32), 31))::INT AS bin, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
    j AS (SELECT id, coalesce(p.n, 0) AS p, coalesce(q.n, 0) AS q FROM h p FULL JOIN (SELECT id - 1 AS id, bin, n FROM h) q USING (id, bin)),
    s AS (SELECT id, sum(p * p) - sum(p) ** 2 / 960 AS vp, sum(q * q) - sum(q) ** 2 / 960 AS vq, sum(p * q) - sum(p) * sum(q) / 960 AS cov FROM j GROUP BY 1)
    SELECT id AS vec_id, round(CASE WHEN vp * vq > 0 THEN (cov / sqrt(vp * vq) + 1) / 2 ELSE 1.0::DOUBLE END, 9) AS similarity FROM s""",
)
def colour_similarity(spark, d):
    bins = pictures.hue_bins(_pixels(spark, d).withColumnRenamed("v", "r"))
    return pictures.colour_similarity(bins, _before(bins)).select(F.col("id").alias("vec_id"), r9("similarity").alias("similarity"))


@query(
    "q131_shape_similarity",
    f"""WITH {IMAGE_SQL}, m AS (SELECT id, x::HUGEINT AS x, y::HUGEINT AS y FROM pix WHERE v > 150),
    s AS (SELECT id, count(*)::HUGEINT AS n, sum(x)::HUGEINT AS x, sum(y)::HUGEINT AS y, sum(x * x)::HUGEINT AS xx, sum(x * y)::HUGEINT AS xy, sum(y * y)::HUGEINT AS yy, sum(x * x * x)::HUGEINT AS xxx, sum(x * x * y)::HUGEINT AS xxy, sum(x * y * y)::HUGEINT AS xyy, sum(y * y * y)::HUGEINT AS yyy FROM m GROUP BY 1),
    c AS (SELECT id, n::DOUBLE AS n, (n * xx - x * x)::DOUBLE / n::DOUBLE ** 3 AS n20, (n * xy - x * y)::DOUBLE / n::DOUBLE ** 3 AS n11, (n * yy - y * y)::DOUBLE / n::DOUBLE ** 3 AS n02,
      (n * n * xxx - 3 * n * x * xx + 2 * x * x * x)::DOUBLE / n::DOUBLE ** 4.5 AS n30, (n * n * yyy - 3 * n * y * yy + 2 * y * y * y)::DOUBLE / n::DOUBLE ** 4.5 AS n03,
      (n * n * xxy - 2 * n * x * xy - n * y * xx + 2 * x * x * y)::DOUBLE / n::DOUBLE ** 4.5 AS n21, (n * n * xyy - 2 * n * y * xy - n * x * yy + 2 * y * y * x)::DOUBLE / n::DOUBLE ** 4.5 AS n12 FROM s),
    k AS (SELECT id, n, n30 + n12 AS a, n21 + n03 AS b, n30 - 3 * n12 AS c, 3 * n21 - n03 AS d, n20 + n02 AS s, n20 - n02 AS t, n11 AS u FROM c),
    h AS (SELECT id, n, list_transform([s, t * t + 4 * u * u, c * c + d * d, a * a + b * b, c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b), t * (a * a - b * b) + 4 * u * a * b, d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b)], lambda z: -sign(z) * log10(abs(z) + 1e-12)) AS hu FROM k),
    o AS (SELECT id, count(*) AS shared FROM m JOIN (SELECT id - 1 AS id, x, y FROM m) USING (id, x, y) GROUP BY 1),
    j AS (SELECT p.id, coalesce(shared, 0) / (p.n + q.n - coalesce(shared, 0)) AS iou, list_sum([abs(p.hu[i] - q.hu[i]) FOR i IN range(1, 8)]) / 7 AS off FROM h p JOIN (SELECT id - 1 AS id, n, hu FROM h) q ON q.id = p.id LEFT JOIN o ON o.id = p.id)
    SELECT id AS vec_id, round(iou, 9) AS iou, round(0.6::DOUBLE * iou + 0.4::DOUBLE * exp(-off / 3), 6) AS similarity FROM j""",
)
def shape_similarity(spark, d):
    m = _pixels(spark, d).filter("v > 150").select("id", "x", "y")
    return pictures.shape_similarity(m, _before(m)).select(F.col("id").alias("vec_id"), r9("iou").alias("iou"), F.round("similarity", 6).alias("similarity"))


@query(
    "q132_edge_overlap",
    f"""WITH RECURSIVE {IMAGE_SQL}, off AS (SELECT dx, dy FROM (SELECT unnest(range(-1, 2)) AS dx), (SELECT unnest(range(-1, 2)) AS dy)),
    g AS (SELECT p.id, p.x, p.y, sum(q.v * dx * (2 - abs(dy))) AS gx, sum(q.v * dy * (2 - abs(dx))) AS gy FROM pix p CROSS JOIN off JOIN pix q ON q.id = p.id AND q.x = least(7, greatest(0, p.x + dx)) AND q.y = least(7, greatest(0, p.y + dy)) GROUP BY ALL),
    s AS (SELECT *, abs(gx) + abs(gy) AS n FROM g),
    r AS (SELECT p.id, p.x, p.y, p.gx, p.gy, p.n, map_from_entries(list((dx * 10 + dy, q.n))) AS m FROM s p CROSS JOIN off JOIN s q ON q.id = p.id AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY ALL),
    t AS (SELECT *, coalesce(m[-10], 0) AS w, coalesce(m[10], 0) AS e, coalesce(m[-1], 0) AS u, coalesce(m[1], 0) AS d, coalesce(m[9], 0) AS ne, coalesce(m[-9], 0) AS sw, coalesce(m[-11], 0) AS nw, coalesce(m[11], 0) AS se FROM r),
    weak AS (SELECT id, x, y, n FROM t WHERE n > 60 AND CASE WHEN abs(gy) < tan(pi() / 8) * abs(gx) THEN n > w AND n >= e WHEN abs(gy) > tan(3 * pi() / 8) * abs(gx) THEN n > u AND n >= d
      WHEN (gx < 0) <> (gy < 0) THEN n > ne AND n > sw ELSE n > nw AND n > se END),
    edge AS (SELECT id, x, y FROM weak WHERE n > 150 UNION SELECT w.id, w.x, w.y FROM edge f JOIN weak w ON w.id = f.id AND abs(w.x - f.x) <= 1 AND abs(w.y - f.y) <= 1),
    next AS (SELECT id - 1 AS id, x, y FROM edge),
    a AS (SELECT id, EXISTS (SELECT 1 FROM next q WHERE q.id = p.id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1) AS hit FROM edge p),
    b AS (SELECT id, EXISTS (SELECT 1 FROM edge q WHERE q.id = p.id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1) AS hit FROM next p),
    k AS (SELECT id, count(*) AS n, count(*) FILTER (hit) AS hits FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1)
    SELECT v.id AS vec_id, coalesce(n, 0)::BIGINT AS n_edges, round(coalesce(hits / n::DOUBLE, 1.0::DOUBLE), 9) AS overlap FROM v LEFT JOIN k ON k.id = v.id""",
)
def edge_overlap(spark, d):
    """Edges of each image and its successor, by components of runs, and how far they lie together."""
    found = cut(outlines.edges(_pixels(spark, d).select("id", "x", "y", F.col("v").alias("value")), (SIDE, SIDE)))
    ids, after = table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), _before(found)
    each = outlines.edge_overlap(ids, found, after, (SIDE, SIDE))
    return each.select(F.col("id").alias("vec_id"), F.col("n").alias("n_edges"), r9("overlap").alias("overlap"))
