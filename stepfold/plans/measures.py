"""Measure queries: depth medians, crops, intrinsics, rotation errors, proposal modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes, camera, depth
from ..operators import match
from .fixtures import HEIGHT, WIDTH, iou_sql, objects, vectors
from .objects import W
from .poses import COMPARED_SQL, _compared
from .poses import W as POSES
from .registry import query, r9

#: The 8 x 8 depth grid of an object: its vector's components, some of them no depths.
GRID_SQL = "SELECT vec_id // 10 AS step_id, (vec_id % 10)::INT AS idx, unnest(range(64)) AS k, unnest(list_transform(embedding::DOUBLE[], lambda v, i: CASE WHEN i % 11 = 0 THEN 'nan'::DOUBLE WHEN i % 13 = 0 THEN 25.0::DOUBLE ELSE 2 + 10 * abs(v) END)) AS depth FROM embeddings"
_EDGE = "greatest(0, least(8, {0}(({1}) * {2})))::INT"


def _side_sql(a: str, b: str, scale: str, i: str) -> str:
    cut = f"least(({b} - {a}) * 0.10::DOUBLE, greatest(0.0::DOUBLE, ({b} - {a} - 1) * 0.45::DOUBLE))"
    return f"{_EDGE.format('floor', f'{a} + {cut}', scale)} AS {i}1, {_EDGE.format('ceil', f'{b} - {cut}', scale)} AS {i}2"


def _depths(spark, d):
    """step_id, idx, grid of each object."""
    grid = F.transform("e", lambda v, i: F.when((i + 1) % 11 == 0, float("nan")).when((i + 1) % 13 == 0, 25.0).otherwise(2 + 10 * F.abs(v)))
    return vectors(spark, d).select(F.floor(F.col("vec_id") / 10).alias("step_id"), (F.col("vec_id") % 10).cast("int").alias("idx"), F.slice(grid, 1, 64).alias("grid"))


def _median_sql(least: int, scale_x: str, scale_y: str, box: tuple[str, str, str, str]) -> str:
    x1, y1, x2, y2 = box
    return f"""{W}, g AS ({GRID_SQL}), b AS (SELECT step_id, idx, {_side_sql(x1, x2, scale_x, 'c')}, {_side_sql(y1, y2, scale_y, 'r')} FROM objects WHERE {x2} - {x1} >= 1 AND {y2} - {y1} >= 1),
    m AS (SELECT b.step_id, b.idx, CASE WHEN count(*) >= {least} THEN round(median(depth), 9) END AS med FROM b JOIN g ON g.step_id = b.step_id AND g.idx = b.idx AND k % 8 >= c1 AND k % 8 < c2 AND k // 8 >= r1 AND k // 8 < r2 WHERE NOT isnan(depth) AND depth > 0.05 AND depth < 20 GROUP BY ALL)
    SELECT o.step_id, o.idx, med AS depth FROM objects o LEFT JOIN m ON m.step_id = o.step_id AND m.idx = o.idx"""


@query("q116_inner_box_median", _median_sql(4, "(8 / 640.0::DOUBLE)", "(8 / 480.0::DOUBLE)", ("gx1", "gy1", "gx2", "gy2")))
def inner_box_median(spark, d):
    j = objects(spark, d).select("step_id", "idx", "gt").join(_depths(spark, d), ["step_id", "idx"])
    return j.select("step_id", "idx", r9(depth.inner_median(F.col("grid"), 8, 8, F.col("gt"), (HEIGHT, WIDTH), least=4)).alias("depth"))


@query("q117_box_median_on_grid", _median_sql(1, "1", "1", ("(gx1 / 80)", "(gy1 / 60)", "(gx2 / 80)", "(gy2 / 60)")))
def box_median_on_grid(spark, d):
    b = F.col("gt")
    small = boxes.box(b["x1"] / 80, b["y1"] / 60, b["x2"] / 80, b["y2"] / 60)
    j = objects(spark, d).select("step_id", "idx", "gt").join(_depths(spark, d), ["step_id", "idx"])
    return j.select("step_id", "idx", r9(depth.inner_median(F.col("grid"), 8, 8, small, least=1)).alias("depth"))


@query("q118_masked_median", f"WITH g AS ({GRID_SQL}) SELECT step_id, idx, round(median(depth) FILTER (k % 3 = idx % 3 AND NOT isnan(depth) AND depth > 0.05 AND depth < 20), 9) AS depth FROM g GROUP BY ALL")
def masked_median(spark, d):
    g = _depths(spark, d)
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: k % 3 == F.col("idx") % 3)
    return g.select("step_id", "idx", r9(depth.masked_median(F.col("grid"), mask)).alias("depth"))


@query("q119_centre_crop", """WITH p AS (SELECT p_partkey, (p_size * 13 + 7)::INT AS w, (p_partkey % 97 + 40)::INT AS h, CASE p_partkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 16 / 9.0::DOUBLE ELSE (p_size * 13 + 7)::DOUBLE / (p_partkey % 97 + 40) END AS a FROM part),
    s AS (SELECT *, abs(w::DOUBLE / h - a) <= 1e-8 AS same FROM p), c AS (SELECT *, CASE WHEN same OR w::DOUBLE / h <= a THEN w ELSE greatest(1, least(w, round_even(h * a, 0)::INT)) END AS cw, CASE WHEN same OR w::DOUBLE / h > a THEN h ELSE greatest(1, least(h, round_even(w / a, 0)::INT)) END AS ch FROM s)
    SELECT p_partkey, (w - cw) // 2 AS x1, (h - ch) // 2 AS y1, (w - cw) // 2 + cw AS x2, (h - ch) // 2 + ch AS y2, NOT same AS applied, greatest(1, least(w, h)) AS side FROM c""")
def centre_crop(spark, d):
    from .fixtures import table

    k = F.col("p_partkey")
    w, h = (F.col("p_size") * 13 + 7).cast("int"), (k % 97 + 40).cast("int")
    p = table(spark, d, "part").select("p_partkey", w.alias("w"), h.alias("h"), F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 16 / 9).otherwise(w / h).alias("a"))
    return p.select("p_partkey", depth.centre_crop(F.col("w"), F.col("h"), F.col("a")).alias("c"), depth.stretch_side(F.col("w"), F.col("h")).alias("side")).select("p_partkey", "c.*", "side")


@query("q120_staged_intrinsics", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE vec_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.5::DOUBLE * 0.25 END AS f FROM embeddings)
    SELECT vec_id, round((500 + 100 * e[1]) * f, 9) AS fx, round((500 + 100 * e[2]) * f, 9) AS fy, round(320 * f, 9) AS cx, round(240 * f, 9) AS cy, 1.0::DOUBLE AS last FROM v""")
def staged_intrinsics(spark, d):
    zero, one = F.lit(0.0), F.lit(1.0)
    k = F.array(F.array(500 + 100 * F.col("e")[0], zero, F.lit(320.0)), F.array(zero, 500 + 100 * F.col("e")[1], F.lit(240.0)), F.array(zero, zero, one))
    n = F.col("vec_id") % 3
    stages = F.when(n == 0, F.array().cast("array<double>")).when(n == 1, F.array(F.lit(0.5))).otherwise(F.array(F.lit(0.5), F.lit(0.25)))
    s = vectors(spark, d).select("vec_id", camera.scaled_intrinsics(k, stages).alias("k"))
    at = F.col("k")
    return s.select("vec_id", r9(at[0][0]).alias("fx"), r9(at[1][1]).alias("fy"), r9(at[0][2]).alias("cx"), r9(at[1][2]).alias("cy"), at[2][2].alias("last"))


@query("q121_rotation_error", f"{POSES}, {COMPARED_SQL} SELECT vec_id, component, CASE WHEN vec_id % 7 <> 0 THEN round(abs_err, 7) END AS error FROM dirs")
def rotation_error(spark, d):
    c = _compared(spark, d)
    pair = (F.when(F.col("vec_id") % 14 == 0, float("inf")).when(F.col("vec_id") % 7 == 0, float("nan")).otherwise(F.col("pred")), F.col("expected"))
    return c.select("vec_id", "component", F.round(depth.rotation_error(F.col("component"), pair, pair, pair), 7).alias("error"))


MASK = "list_transform(feature, lambda v: v > 0)"


@query("q122_hybrid_proposals", f"""WITH RECURSIVE {W.removeprefix('WITH ')}, a AS (
      SELECT step_id, idx, 'auto' AS source, 0.90::DOUBLE AS score, CASE WHEN idx % 3 = 0 THEN gx1 ELSE px1 END AS x1, CASE WHEN idx % 3 = 0 THEN gy1 ELSE py1 END AS y1, CASE WHEN idx % 3 = 0 THEN gx2 ELSE px2 END AS x2, CASE WHEN idx % 3 = 0 THEN gy2 ELSE py2 END AS y2,
        list_transform(feature, lambda v: CASE WHEN idx = 9 THEN false WHEN idx % 2 = 0 THEN v > 0.02 ELSE v <= 0 END) AS mask FROM objects
      UNION ALL SELECT step_id, idx, 'text', 1.0::DOUBLE, gx1, gy1, gx2, gy2, list_transform(feature, lambda v: v > 0) FROM objects WHERE idx <> 5),
    s AS (SELECT *, len(list_filter(mask, lambda m: m)) AS area FROM a),
    k AS (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY score DESC, area DESC, source, idx) AS n FROM s),
    j AS (SELECT i.step_id, i.n, j.n AS other FROM k i JOIN k j ON i.step_id = j.step_id AND j.n < i.n AND ({iou_sql('i.', 'j.')} >= 0.88
      OR len(list_filter(list_zip(i.mask, j.mask), lambda z: z[1] AND z[2]))::DOUBLE / greatest(1, len(list_filter(list_zip(i.mask, j.mask), lambda z: z[1] OR z[2]))) >= 0.72)),
    o AS (SELECT k.step_id, k.n, k.idx, k.source, k.area, coalesce(list(j.other) FILTER (j.other IS NOT NULL), []) AS against FROM k LEFT JOIN j USING (step_id, n) GROUP BY ALL),
    walk AS (SELECT DISTINCT step_id, 0::BIGINT AS n, []::BIGINT[] AS kept FROM o
      UNION ALL SELECT w.step_id, o.n, CASE WHEN area > 0 AND len(kept) < 60 AND NOT list_has_any(kept, against) THEN list_append(kept, o.n) ELSE kept END FROM walk w JOIN o ON o.step_id = w.step_id AND o.n = w.n + 1),
    done AS (SELECT step_id, unnest(arg_max(kept, n)) AS n, unnest(range(len(arg_max(kept, n))))::INT AS rank FROM walk GROUP BY step_id)
    SELECT step_id, idx, source, rank FROM done JOIN o USING (step_id, n)""")
def hybrid_proposals(spark, d):
    o, i = objects(spark, d), F.col("idx")
    mask = F.transform("feature", lambda v: F.when(i == 9, False).when(i % 2 == 0, v > 0.02).otherwise(v <= 0))
    third = F.when(i % 3 == 0, F.col("gt")).otherwise(F.col("pred"))
    auto = o.select("step_id", "idx", F.lit("").alias("label"), mask.alias("mask"), third.alias("b")).select("step_id", "idx", "label", "mask", "b.*")
    text = o.filter(i != 5).select("step_id", "idx", "label", F.transform("feature", lambda v: v > 0).alias("mask"), "gt.*")
    return match.proposals("hybrid", {"auto": auto, "text": text})
