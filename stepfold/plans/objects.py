"""Object queries: geometry, filters, spatial joins, matching, relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes, labels
from ..functions.scores import available_composite
from ..operators import match, pairs
from ..operators.grid import hull, meeting
from .fixtures import HEIGHT, OBJECTS_SQL, SIGNALS_SQL, WIDTH, iou_sql, objects, signals
from .registry import query, r9

W = f"WITH {OBJECTS_SQL}"
DIAG = "sqrt(480.0::DOUBLE * 480 + 640.0::DOUBLE * 640)"
#: SQL of a label's canonical name, from the synonym groups.
CANON = "CASE {0} " + " ".join(f"WHEN '{n}' THEN '{g[0]}'" for g in labels.SYNONYMS for n in g) + " ELSE {0} END"


def _cross(spark, d):
    """Ground-truth and predicted objects of a step: (step_id, g, p)."""
    o = objects(spark, d)
    cols = [c for c in o.columns if c != "step_id"]
    return o.select("step_id", F.struct(*cols).alias("g")).join(o.select("step_id", F.struct(*cols).alias("p")), "step_id")


CROSS_SQL = "x AS (SELECT g.step_id, g, p FROM objects g JOIN objects p USING (step_id))"


@query("q38_box_iou_pairs", f"{W} SELECT step_id, a.idx AS a, b.idx AS b, round({iou_sql('a.g', 'b.g')}, 9) AS iou, round({iou_sql('a.g', 'b.g', 1e-6)}, 9) AS iou_eps FROM pairs")
def box_iou_pairs(spark, d):
    p = pairs.pairs(objects(spark, d).select("step_id", "idx", "gt"))
    a, b = F.col("a.gt"), F.col("b.gt")
    return p.select("step_id", F.col("a.idx").alias("a"), F.col("b.idx").alias("b"), r9(boxes.iou(a, b)).alias("iou"), r9(boxes.iou_eps(a, b)).alias("iou_eps"))


@query("q36_label_canonical_compatible", f"{W} SELECT step_id, a.idx AS a, b.idx AS b, {CANON.format('a.label')} AS canon, {CANON.format('a.label')} = {CANON.format('b.label')} AS compatible FROM pairs")
def label_compatible(spark, d):
    p = pairs.pairs(objects(spark, d).select("step_id", "idx", "label"))
    return p.select("step_id", F.col("a.idx").alias("a"), F.col("b.idx").alias("b"), labels.canonical(F.col("a.label")).alias("canon"), labels.compatible(F.col("a.label"), F.col("b.label")).alias("compatible"))


NEAR_SQL = f"""{CANON.format('g.label')} = {CANON.format('p.label')} AND ({iou_sql('g.g', 'p.p')} > 0
  OR (p.pcx BETWEEN g.gx1 - greatest(12.8::DOUBLE, greatest(1.0::DOUBLE, g.gx2 - g.gx1) * 0.5) AND g.gx2 + greatest(12.8::DOUBLE, greatest(1.0::DOUBLE, g.gx2 - g.gx1) * 0.5)
  AND p.pcy BETWEEN g.gy1 - greatest(12.8::DOUBLE, greatest(1.0::DOUBLE, g.gy2 - g.gy1) * 0.5) AND g.gy2 + greatest(12.8::DOUBLE, greatest(1.0::DOUBLE, g.gy2 - g.gy1) * 0.5))
  OR sqrt((p.pcx - g.gcx) * (p.pcx - g.gcx) + (p.pcy - g.gcy) * (p.pcy - g.gcy)) / {DIAG} <= 0.12)"""


@query("q39_neighbourhood_filter", f"{W}, {CROSS_SQL} SELECT DISTINCT step_id, p.idx AS idx, p.label AS label FROM x WHERE {NEAR_SQL}")
def neighbourhood_filter(spark, d):
    o = objects(spark, d)
    gt, reach = F.col("gt"), 0.12 * (HEIGHT**2 + WIDTH**2) ** 0.5
    wide = boxes.expanded(gt, 0.5, 0.02 * WIDTH)
    x, y = boxes.center_x(gt), boxes.center_y(gt)
    g = o.select("step_id", F.col("label").alias("gl"), F.col("gt").alias("g"), hull(gt, wide, boxes.box(x - reach, y - reach, x + reach, y + reach)).alias("at"))
    p = o.select("step_id", "idx", "label", "pred", hull(F.col("pred"), F.col("pred")).alias("at"))
    met = meeting(g, p, ["step_id"], "at", "at", cell=256.0).select("l.g", "l.gl", "r.*")
    gb, pb = F.col("g"), F.col("pred")
    near = (boxes.iou(gb, pb) > 0) | boxes.expanded_contains(gb, pb, 0.5, 0.02 * WIDTH) | (boxes.center_distance(gb, pb, HEIGHT, WIDTH) <= 0.12)
    return met.filter(labels.compatible(F.col("gl"), F.col("label")) & near).select("step_id", "idx", "label").distinct()


QUALITY_SQL = """q AS (SELECT step_id, idx, label, greatest(0.0::DOUBLE, least(639.0::DOUBLE, round_even(gx1, 0))) AS x1, greatest(0.0::DOUBLE, least(639.0::DOUBLE, round_even(gx2, 0))) AS x2,
   greatest(0.0::DOUBLE, least(479.0::DOUBLE, round_even(gy1, 0))) AS y1, greatest(0.0::DOUBLE, least(479.0::DOUBLE, round_even(gy2, 0))) AS y2 FROM objects),
 s AS (SELECT *, greatest(1.0::DOUBLE, x2 - x1) AS bw, greatest(1.0::DOUBLE, y2 - y1) AS bh FROM q),
 t AS (SELECT *, bw * bh / 307200.0::DOUBLE AS area, least(bw, bh) / 480.0::DOUBLE AS side, (x1 <= 1)::INT + (y1 <= 1)::INT + (x2 >= 638)::INT + (y2 >= 478)::INT AS touches,
   (x1 <= 25.6 OR y1 <= 19.2 OR x2 >= 614.4 OR y2 >= 460.8) AS near, greatest(bw, bh) / greatest(least(bw, bh), 1.0::DOUBLE) AS aspect FROM s)"""


def _quality(o):
    b = boxes.safe_box(F.col("gt"), HEIGHT, WIDTH)
    x = o.select("step_id", "idx", "label", b.alias("b"))
    b = F.col("b")
    bw, bh = F.greatest(F.lit(1.0), b["x2"] - b["x1"]), F.greatest(F.lit(1.0), b["y2"] - b["y1"])
    touches = (b["x1"] <= 1).cast("int") + (b["y1"] <= 1).cast("int") + (b["x2"] >= WIDTH - 2).cast("int") + (b["y2"] >= HEIGHT - 2).cast("int")
    mx, my = 0.04 * WIDTH, 0.04 * HEIGHT
    near = (b["x1"] <= mx) | (b["y1"] <= my) | (b["x2"] >= WIDTH - mx) | (b["y2"] >= HEIGHT - my)
    x = x.withColumns({"area": bw * bh / (HEIGHT * WIDTH), "side": F.least(bw, bh) / min(HEIGHT, WIDTH), "touches": touches, "near": near, "aspect": F.greatest(bw, bh) / F.greatest(F.least(bw, bh), F.lit(1.0))})
    area, side = F.col("area"), F.col("side")
    # Thresholds of the quality rules.
    rules = [
        ("invalid_box", b.isNull()),
        ("ignored_label", F.col("label").isin("shelf")),
        ("small_box_area", area < 0.006),
        ("small_box_side", side < 0.035),
        ("partial_edge_small", (F.col("touches") > 0) & (area < 0.03)),
        ("partial_corner", (F.col("touches") >= 2) & (area < 0.06)),
        ("near_border_thin_fragment", F.col("near") & (area < 0.05) & ((side < 0.09) | (F.col("aspect") >= 3.5))),
    ]
    return x.withColumn("reasons", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules))))


@query(
    "q40_quality_filter_reasons",
    f"""{W}, {QUALITY_SQL} SELECT step_id, idx, label, concat_ws(',', CASE WHEN x2 <= x1 OR y2 <= y1 THEN 'invalid_box' END, CASE WHEN label = 'shelf' THEN 'ignored_label' END,
    CASE WHEN x2 > x1 AND y2 > y1 AND area < 0.006 THEN 'small_box_area' END, CASE WHEN x2 > x1 AND y2 > y1 AND side < 0.035 THEN 'small_box_side' END, CASE WHEN x2 > x1 AND y2 > y1 AND touches > 0 AND area < 0.03 THEN 'partial_edge_small' END,
    CASE WHEN x2 > x1 AND y2 > y1 AND touches >= 2 AND area < 0.06 THEN 'partial_corner' END, CASE WHEN x2 > x1 AND y2 > y1 AND near AND area < 0.05 AND (side < 0.09 OR aspect >= 3.5) THEN 'near_border_thin_fragment' END) AS reasons FROM t""",
)
def quality_filter_reasons(spark, d):
    return _quality(objects(spark, d)).select("step_id", "idx", "label", F.array_join("reasons", ",").alias("reasons"))


@query("q47_relative_topology", f"""{W}, v AS (SELECT step_id, a.matched AND b.matched AS bth, a.gcx - b.gcx AS gx, a.gcy - b.gcy AS gy, a.pcx - b.pcx AS px, a.pcy - b.pcy AS py,
    (a.gt_depth - b.gt_depth) / greatest((abs(a.gt_depth) + abs(b.gt_depth)) / 2, 1e-8::DOUBLE) AS gg, (a.pred_depth - b.pred_depth) / greatest((abs(a.pred_depth) + abs(b.pred_depth)) / 2, 1e-8::DOUBLE) AS pg FROM pairs),
    s AS (SELECT *, CASE WHEN bth AND sqrt(px * px + py * py) >= 1e-8 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (gx * px + gy * py) / (sqrt(gx * gx + gy * gy) * sqrt(px * px + py * py)))) ELSE 0.0::DOUBLE END AS planar,
      abs(gg) > 0.03 AS eligible, abs(gg) > 0.03 AND bth AS valid, abs(gg) > 0.03 AND bth AND abs(pg) <= 0.03 AS tie, abs(gg) > 0.03 AND bth AND abs(pg) > 0.03 AND gg * pg > 0 AS ok FROM v)
    SELECT step_id, round(avg(planar), 9) AS planar_all, round(avg(planar) FILTER (bth), 9) AS planar_matched, round(count(*) FILTER (ok)::DOUBLE / nullif(count(*) FILTER (eligible), 0), 9) AS depth_all,
      round(count(*) FILTER (ok)::DOUBLE / nullif(count(*) FILTER (valid), 0), 9) AS depth_valid, round(avg(CASE WHEN eligible THEN (planar + ok::INT) / 2 ELSE planar END), 9) AS relative_all,
      round(count(*) FILTER (bth)::DOUBLE / count(*), 9) AS pair_coverage, round(count(*) FILTER (eligible)::DOUBLE / count(*), 9) AS eligibility, count(*) FILTER (eligible) AS num_eligible,
      count(*) FILTER (valid) AS num_valid, count(*) FILTER (ok) AS num_correct, count(*) FILTER (tie) AS num_ties FROM s GROUP BY 1""")
def relative_topology(spark, d):
    t = pairs.relative_topology(objects(spark, d))
    return t.select(*(F.col(c) if c.startswith("num") or c == "step_id" else r9(c).alias(c) for c in t.columns))


@query("q48_legacy_topology", f"""{W}, v AS (SELECT step_id, a.matched AND b.matched AS bth, a.gcx - b.gcx AS gx, a.gcy - b.gcy AS gy, a.pcx - b.pcx AS px, a.pcy - b.pcy AS py FROM pairs),
    n AS (SELECT *, sqrt(gx * gx + gy * gy) AS ng, sqrt(px * px + py * py) AS np FROM v),
    s AS (SELECT *, CASE WHEN NOT bth THEN 0.0::DOUBLE WHEN ng < 1e-6 OR np < 1e-6 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, (gx * px + gy * py) / (ng * np + 1e-8::DOUBLE)) * least(np / (ng + 1e-8::DOUBLE), 1 / (np / (ng + 1e-8::DOUBLE) + 1e-8::DOUBLE)) END AS score FROM n)
    SELECT step_id, round(avg(score), 9) AS topology, count(*) AS num_pairs, count(*) FILTER (bth) AS matched_pairs, count(*) FILTER (score > 0) AS positive_pairs, round(count(*) FILTER (bth)::DOUBLE / count(*), 9) AS coverage FROM s GROUP BY 1""")
def legacy_topology(spark, d):
    t = pairs.legacy_topology(objects(spark, d))
    return t.withColumns({"topology": r9("topology"), "coverage": r9("coverage")})


@query("q49_matched_layout", f"""{W}, m AS (SELECT *, greatest(1.0::DOUBLE, greatest(0.0::DOUBLE, round_even(gx2, 0) - round_even(gx1, 0)) * greatest(0.0::DOUBLE, round_even(gy2, 0) - round_even(gy1, 0))) AS ga,
      greatest(1.0::DOUBLE, greatest(0.0::DOUBLE, round_even(px2, 0) - round_even(px1, 0)) * greatest(0.0::DOUBLE, round_even(py2, 0) - round_even(py1, 0))) AS pa FROM objects WHERE matched),
    one AS (SELECT step_id, avg(pa / ga) AS area_ratio, avg(least(pa / ga, 1 / greatest(pa / ga, 1e-6::DOUBLE))) AS area_score FROM m GROUP BY 1),
    v AS (SELECT a.step_id, a.gcx - b.gcx AS gx, a.gcy - b.gcy AS gy, a.pcx - b.pcx AS px, a.pcy - b.pcy AS py, greatest(1.0::DOUBLE, abs(a.gcx) + abs(b.gcx)) AS sx, greatest(1.0::DOUBLE, abs(a.gcy) + abs(b.gcy)) AS sy,
      (a.pa / b.pa) / greatest(a.ga / b.ga, 1e-6::DOUBLE) AS rel FROM m a JOIN m b ON a.step_id = b.step_id AND a.idx < b.idx),
    s AS (SELECT *, CASE WHEN abs(gx) / sx >= 0.03 AND abs(px) / sx >= 0.03 THEN (sign(gx) = sign(px))::INT::DOUBLE END AS ax, CASE WHEN abs(gy) / sy >= 0.03 AND abs(py) / sy >= 0.03 THEN (sign(gy) = sign(py))::INT::DOUBLE END AS ay FROM v),
    l AS (SELECT *, (coalesce(ax, 0) + coalesce(ay, 0)) / nullif((ax IS NOT NULL)::INT + (ay IS NOT NULL)::INT, 0) AS loc FROM s),
    two AS (SELECT step_id, avg(loc) AS location, count(loc) AS location_pairs, avg(least(rel, 1 / greatest(rel, 1e-6::DOUBLE))) AS pair_area_score FROM l GROUP BY 1)
    SELECT step_id, round(area_ratio, 9) AS area_ratio, round(area_score, 9) AS area_score, round(location, 9) AS location, coalesce(location_pairs, 0) AS location_pairs, round(pair_area_score, 9) AS pair_area_score FROM one LEFT JOIN two USING (step_id)""")
def matched_layout(spark, d):
    t = pairs.matched_layout(objects(spark, d))
    return t.select("step_id", *(r9(c).alias(c) for c in ("area_ratio", "area_score", "location", "pair_area_score")), "location_pairs")


@query("q50_depth_order_tau", f"""{W}, v AS (SELECT step_id, a.gt_depth - b.gt_depth AS g, a.pred_depth - b.pred_depth AS p FROM pairs WHERE a.matched AND b.matched),
    s AS (SELECT *, abs(g) < 0.03 OR abs(p) < 0.03 AS skip FROM v), c AS (SELECT step_id, count(*) FILTER (NOT skip) AS used, count(*) FILTER (NOT skip AND g * p > 0) AS same, count(*) FILTER (skip) AS skipped FROM s GROUP BY 1)
    SELECT step_id, round(same::DOUBLE / nullif(used, 0), 9) AS accuracy, round((2 * same - used)::DOUBLE / nullif(used, 0), 9) AS tau, used AS num_pairs, skipped FROM c""")
def depth_order(spark, d):
    t = pairs.depth_order(objects(spark, d))
    return t.select("step_id", r9("accuracy").alias("accuracy"), r9("tau").alias("tau"), "num_pairs", "skipped")


@query("q55_class_count_accuracy", f"""{W}, g AS (SELECT step_id, {CANON.format('label')} AS cls, count(*) AS n FROM objects GROUP BY ALL), p AS (SELECT step_id, {CANON.format('label')} AS cls, count(*) AS n FROM objects WHERE matched GROUP BY ALL),
    c AS (SELECT coalesce(g.step_id, p.step_id) AS step_id, coalesce(g.n, 0) AS ng, coalesce(p.n, 0) AS np FROM g FULL JOIN p ON g.step_id = p.step_id AND g.cls = p.cls)
    SELECT step_id, round(sum(least(ng, np)::DOUBLE / greatest(ng, np) * greatest(ng, np)) / sum(greatest(ng, np)), 9) AS count_accuracy, sum(greatest(0, np - ng))::BIGINT AS extra, sum(greatest(0, ng - np))::BIGINT AS missing FROM c GROUP BY 1""")
def class_count_accuracy(spark, d):
    # both counts in one pass: a class that only one side has still gets its row
    o = objects(spark, d).select("step_id", labels.canonical(F.col("label")).alias("cls"), "matched")
    c = o.groupBy("step_id", "cls").agg(F.count("*").alias("ng"), F.count_if("matched").alias("np"))
    top, low = F.greatest("ng", "np"), F.least("ng", "np")
    return c.groupBy("step_id").agg(r9(F.sum(low / top * top) / F.sum(top)).alias("count_accuracy"), F.sum(F.greatest(F.lit(0), F.col("np") - F.col("ng"))).alias("extra"), F.sum(F.greatest(F.lit(0), F.col("ng") - F.col("np"))).alias("missing"))


@query("q56_theta_match_candidates", f"{W}, {CROSS_SQL} SELECT step_id, g.idx AS gt_idx, p.idx AS pred_idx, round({iou_sql('g.g', 'p.p', 1e-6)}, 9) AS iou FROM x WHERE g.label = p.label AND {iou_sql('g.g', 'p.p', 1e-6)} >= 0.25")
def theta_match_candidates(spark, d):
    return _candidates(spark, d).select("step_id", "gt_idx", "pred_idx", r9("iou").alias("iou"))


def _candidates(spark, d, tau: float = 0.25):
    o = objects(spark, d)
    g = o.select("step_id", "label", F.col("idx").alias("gt_idx"), "gt", F.col("feature").alias("gf"))
    p = o.select("step_id", "label", F.col("idx").alias("pred_idx"), "pred", F.col("feature").alias("pf"))
    g, p = g.withColumn("at", hull(F.col("gt"), F.col("gt"))), p.withColumn("at", hull(F.col("pred"), F.col("pred")))
    # boxes that overlap at all touch, so the grid misses none
    j = meeting(g, p, ["step_id", "label"], "at", "at").select("l.step_id", "l.gt_idx", "l.gt", "l.gf", "r.pred_idx", "r.pred", "r.pf")
    j = j.withColumn("iou", boxes.iou_eps(F.col("gt"), F.col("pred"))).filter(F.col("iou") >= tau)
    dot = F.aggregate(F.zip_with("gf", "pf", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return j.select("step_id", "gt_idx", "pred_idx", "iou", dot.alias("similarity"))


@query("q57_extra_objects", f"""{W} SELECT step_id, idx FROM objects e WHERE NOT matched
    AND NOT EXISTS (SELECT 1 FROM objects m WHERE m.step_id = e.step_id AND m.matched AND {iou_sql('m.p', 'e.p')} > 0.5)
    AND NOT EXISTS (SELECT 1 FROM objects g WHERE g.step_id = e.step_id AND g.idx <> e.idx AND ({iou_sql('g.g', 'e.p')} > 0.25 OR (e.pcx BETWEEN g.gx1 AND g.gx2 AND e.pcy BETWEEN g.gy1 AND g.gy2)))""")
def extra_objects(spark, d):
    o = objects(spark, d)
    e = o.filter("NOT matched").select("step_id", "idx", "pred")
    m = o.filter("matched").select(F.col("step_id").alias("s"), F.col("pred").alias("b"))
    e = e.join(m, (F.col("step_id") == F.col("s")) & (boxes.iou(F.col("b"), F.col("pred")) > 0.5), "left_anti")
    g = o.select(F.col("step_id").alias("s"), F.col("idx").alias("gi"), F.col("gt").alias("b"))
    hit = (boxes.iou(F.col("b"), F.col("pred")) > 0.25) | boxes.center_inside(F.col("pred"), F.col("b"))
    return e.join(g, (F.col("step_id") == F.col("s")) & (F.col("idx") != F.col("gi")) & hit, "left_anti").select("step_id", "idx")


@query("q58_nearest_within_radius", f"""{W}, {CROSS_SQL}, n AS (SELECT step_id, g.idx AS gt_idx, p.idx AS pred_idx, sqrt((g.gcx - p.pcx) * (g.gcx - p.pcx) + (g.gcy - p.pcy) * (g.gcy - p.pcy)) / {DIAG} AS dist FROM x WHERE g.idx <> p.idx),
    r AS (SELECT *, row_number() OVER (PARTITION BY step_id, gt_idx ORDER BY round(dist, 9), pred_idx) AS k FROM n WHERE dist <= 0.35) SELECT step_id, gt_idx, pred_idx, round(dist, 9) AS distance FROM r WHERE k = 1""")
def nearest_within_radius(spark, d):
    dist = boxes.center_distance(F.col("g.gt"), F.col("p.pred"), HEIGHT, WIDTH)
    n = _cross(spark, d).filter("g.idx <> p.idx").select("step_id", F.col("g.idx").alias("gt_idx"), F.col("p.idx").alias("pred_idx"), dist.alias("dist")).filter("dist <= 0.35")
    return n.groupBy("step_id", "gt_idx").agg(F.min(F.struct(r9("dist").alias("distance"), F.col("pred_idx"))).alias("x")).select("step_id", "gt_idx", "x.pred_idx", "x.distance")


@query("q31_best_context", f"""{W}, {CROSS_SQL}, n AS (SELECT step_id, g.idx AS target, p.idx AS context, round({iou_sql('g.g', 'p.g')}, 9) AS overlap FROM x WHERE g.idx <> p.idx),
    r AS (SELECT *, row_number() OVER (PARTITION BY step_id, target ORDER BY overlap DESC, context) AS k FROM n) SELECT step_id, target, context, overlap FROM r WHERE k = 1""")
def best_context(spark, d):
    n = _cross(spark, d).filter("g.idx <> p.idx").select("step_id", F.col("g.idx").alias("target"), F.col("p.idx").alias("context"), r9(boxes.iou(F.col("g.gt"), F.col("p.gt"))).alias("overlap"))
    # the first of equal overlaps wins
    return n.groupBy("step_id", "target").agg(F.min(F.struct((-F.col("overlap")).alias("inv"), "context")).alias("x")).select("step_id", "target", "x.context", (0.0 - F.col("x.inv")).alias("overlap"))


BUDGET_SQL = """rk AS (SELECT *, row_number() OVER (PARTITION BY step_id, label ORDER BY score DESC, idx) AS lk FROM objects), cap AS (SELECT * FROM rk WHERE lk <= CASE WHEN label IN ('chair', 'stool', 'shelf', 'bookshelf') THEN 1 ELSE 2 END),
    gk AS (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY score DESC, idx) AS k FROM cap)"""


@query("q59_per_label_and_global_topk", f"{W}, {BUDGET_SQL} SELECT step_id, idx, label, k::INT AS place FROM gk WHERE k <= 6")
def budgets(spark, d):
    o = objects(spark, d).select("step_id", "idx", "label", "score")
    by = [F.desc("score"), "idx"]
    o = o.withColumn("lk", F.row_number().over(Window.partitionBy("step_id", "label").orderBy(*by)))
    o = o.filter(F.col("lk") <= F.when(F.col("label").isin("chair", "stool", "shelf", "bookshelf"), 1).otherwise(2))
    return o.withColumn("place", F.row_number().over(Window.partitionBy("step_id").orderBy(*by))).filter("place <= 6").select("step_id", "idx", "label", "place")


def _detections(spark, d):
    return objects(spark, d).select("step_id", "idx", "label", "score", "pred.*")


@query("q60_greedy_nms", f"""WITH RECURSIVE {OBJECTS_SQL}, k AS (SELECT step_id, idx, row_number() OVER (PARTITION BY step_id ORDER BY score DESC, idx) AS n FROM objects),
    c AS (SELECT a.step_id, a.idx, coalesce(list(b.idx) FILTER (b.idx IS NOT NULL), []) AS against FROM objects a LEFT JOIN objects b ON a.step_id = b.step_id AND a.idx <> b.idx AND {iou_sql('a.p', 'b.p')} >= 0.3 GROUP BY ALL),
    o AS (SELECT * FROM k JOIN c USING (step_id, idx)),
    walk AS (SELECT DISTINCT step_id, 0::BIGINT AS n, []::INT[] AS kept FROM o
      UNION ALL SELECT w.step_id, o.n, CASE WHEN len(kept) < 60 AND NOT list_has_any(kept, against) THEN list_append(kept, o.idx) ELSE kept END FROM walk w JOIN o ON o.step_id = w.step_id AND o.n = w.n + 1),
    done AS (SELECT step_id, arg_max(kept, n) AS kept FROM walk GROUP BY 1) SELECT step_id, unnest(kept) AS idx, (generate_subscripts(kept, 1) - 1)::INT AS rank FROM done""")
def greedy_nms(spark, d):
    return match.nms(_detections(spark, d), tau=0.3)


@query("q61_greedy_one_to_one", f"""WITH RECURSIVE {OBJECTS_SQL}, {CROSS_SQL}, c AS (SELECT step_id, g.idx AS gt_idx, p.idx AS pred_idx, round({iou_sql('g.g', 'p.p', 1e-6)}, 9) AS iou, round(list_dot_product(g.feature, p.feature), 9) AS similarity FROM x
      WHERE g.label = p.label AND {iou_sql('g.g', 'p.p', 1e-6)} >= 0.05), k AS (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY iou DESC, similarity DESC, gt_idx, pred_idx) AS n FROM c),
    walk AS (SELECT DISTINCT step_id, 0::BIGINT AS n, []::INT[] AS gs, []::INT[] AS ps, false AS took FROM k
      UNION ALL SELECT w.step_id, k.n, CASE WHEN list_contains(gs, gt_idx) OR list_contains(ps, pred_idx) THEN gs ELSE list_append(gs, gt_idx) END,
        CASE WHEN list_contains(gs, gt_idx) OR list_contains(ps, pred_idx) THEN ps ELSE list_append(ps, pred_idx) END, NOT (list_contains(gs, gt_idx) OR list_contains(ps, pred_idx)) FROM walk w JOIN k ON k.step_id = w.step_id AND k.n = w.n + 1)
    SELECT step_id, gt_idx, pred_idx, iou, similarity FROM walk JOIN k USING (step_id, n) WHERE took""")
def greedy_one_to_one(spark, d):
    return match.greedy_match(_candidates(spark, d, 0.05).withColumns({"iou": r9("iou"), "similarity": r9("similarity")}))


def _assignment_sql() -> str:
    """The best sum over sets of used predictions, one ground-truth object after the other."""
    ctes = ["f0 AS (SELECT DISTINCT step_id, 0 AS used, 0.0::DOUBLE AS total, []::STRUCT(gt_idx INT, pred_idx INT, weight DOUBLE)[] AS path FROM cand)"]
    for i in range(10):
        ctes.append(f"""f{i + 1} AS (SELECT step_id, used, max(total) AS total, arg_max(path, total) AS path FROM (SELECT * FROM f{i}
          UNION ALL SELECT step_id, used | (1 << pred_idx), total + weight, list_append(path, {{'gt_idx': gt_idx, 'pred_idx': pred_idx, 'weight': weight}}) FROM f{i} JOIN cand USING (step_id) WHERE gt_idx = {i} AND used & (1 << pred_idx) = 0) GROUP BY ALL)""")
    return ", ".join(ctes)


@query("q62_optimal_assignment", f"""{W}, {CROSS_SQL}, cand AS (SELECT step_id, g.idx AS gt_idx, p.idx AS pred_idx, 1 - sqrt((g.gcx - p.pcx) * (g.gcx - p.pcx) + (g.gcy - p.pcy) * (g.gcy - p.pcy)) / {DIAG} AS weight FROM x WHERE sqrt((g.gcx - p.pcx) * (g.gcx - p.pcx) + (g.gcy - p.pcy) * (g.gcy - p.pcy)) / {DIAG} <= 0.35),
    {_assignment_sql()}, best AS (SELECT step_id, unnest(arg_max(path, total)) AS x FROM f10 GROUP BY 1) SELECT step_id, x.gt_idx AS gt_idx, x.pred_idx AS pred_idx, round(x.weight, 9) AS weight FROM best""")
def optimal_assignment(spark, d):
    near = _cross(spark, d).select("step_id", F.col("g.idx").alias("gt_idx"), F.col("p.idx").alias("pred_idx"), (1 - boxes.center_distance(F.col("g.gt"), F.col("p.pred"), HEIGHT, WIDTH)).alias("weight"))
    return match.optimal_match(near.filter("weight >= 0.65")).withColumn("weight", r9("weight"))


@query("q63_demote_split", f"""{W}, v AS (SELECT step_id, idx, CASE WHEN idx % 4 = 3 THEN NULL ELSE score < 0.2 END AS same, 0.85::DOUBLE + 0.1 * score AS conf, 1 - score AS ident FROM objects WHERE matched),
    k AS (SELECT *, coalesce(same AND conf >= 0.9 AND ident >= 0.78, true) AS keep FROM v)
    SELECT step_id, 'match' AS status, idx AS gt_idx, idx AS pred_idx FROM k WHERE keep UNION ALL SELECT step_id, 'missing', idx, NULL FROM k WHERE NOT keep UNION ALL SELECT step_id, 'hallucination', NULL, idx FROM k WHERE NOT keep""")
def demote_split(spark, d):
    s = F.col("score")
    v = objects(spark, d).filter("matched").select("step_id", F.col("idx").alias("gt_idx"), F.col("idx").alias("pred_idx"), F.when(F.col("idx") % 4 != 3, s < 0.2).alias("same"), (0.85 + 0.1 * s).alias("confidence"), (1 - s).alias("identity"))
    return match.demote(v)


WEIGHTS = {"identity_sim": 0.30, "struct_ssim": 0.20, "edge_iou": 0.15, "sharpness_ratio": 0.12, "color_sim": 0.13, "shape_sim": 0.10}
#: Below these a signal is a defect.
FLAGS = {"identity_sim": (0.45, "identity_drift"), "struct_ssim": (0.30, "structural_deformation"), "edge_iou": (0.10, "contour_mismatch"), "sharpness_ratio": (0.35, "blur_or_melt"), "color_sim": (0.40, "color_texture_drift"), "shape_sim": (0.30, "warped_silhouette")}


@query(
    "q64_weighted_available_composite",
    f"WITH {SIGNALS_SQL} SELECT vec_id, round(({' + '.join(f'coalesce({k} * {w}::DOUBLE, 0)' for k, w in WEIGHTS.items())}) / ({' + '.join(f'CASE WHEN {k} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END' for k, w in WEIGHTS.items())}), 9) AS quality, concat_ws(',', "
    + ", ".join(f"CASE WHEN {k} < {t} THEN '{n}' END" for k, (t, n) in FLAGS.items())
    + ") AS flags FROM signals",
)
def composite(spark, d):
    s = signals(spark, d)
    flags = F.array_compact(F.array(*(F.when(F.col(k) < t, n) for k, (t, n) in FLAGS.items())))
    return s.select("vec_id", r9(available_composite([F.col(k) for k in WEIGHTS], list(WEIGHTS.values()))).alias("quality"), F.array_join(flags, ",").alias("flags"))


@query("q73_canonical_select", f"{W} SELECT step_id, idx, CASE WHEN matched THEN 'match' ELSE 'missing' END AS status, round(gx1, 9) AS gx1, CASE WHEN matched THEN round(px1, 9) END AS px1 FROM objects")
def canonical_select(spark, d):
    return objects(spark, d).select("step_id", "idx", F.when(F.col("matched"), "match").otherwise("missing").alias("status"), r9("gt.x1").alias("gx1"), F.when(F.col("matched"), r9("pred.x1")).alias("px1"))


@query("q79_record_depth_join", f"""{W} SELECT step_id, count(*) AS num_gt, count(*) FILTER (matched) AS num_matched, CASE WHEN count(*) >= 2 THEN round(median(gt_depth), 9) END AS gt_median,
    CASE WHEN count(*) >= 2 AND count(*) FILTER (matched) >= 2 THEN round(median(pred_depth) FILTER (matched), 9) END AS pred_median FROM objects GROUP BY 1""")
def record_depth_join(spark, d):
    n, m = F.count("*"), F.count_if("matched")
    pred = F.median(F.when(F.col("matched"), F.col("pred_depth")))
    return objects(spark, d).groupBy("step_id").agg(n.alias("num_gt"), m.alias("num_matched"), F.when(n >= 2, r9(F.median("gt_depth"))).alias("gt_median"), F.when((n >= 2) & (m >= 2), r9(pred)).alias("pred_median"))


@query("q81_best_resemblance", f"""{W}, {CROSS_SQL}, s AS (SELECT step_id, p.idx AS pred_idx, g.idx AS gt_idx, round(list_dot_product(g.feature, p.feature) / (sqrt(list_dot_product(g.feature, g.feature)) * sqrt(list_dot_product(p.feature, p.feature))), 9) AS sim FROM x
    WHERE {CANON.format('g.label')} = {CANON.format('p.label')} AND g.idx <> p.idx), r AS (SELECT *, row_number() OVER (PARTITION BY step_id, pred_idx ORDER BY sim DESC, gt_idx) AS k FROM s) SELECT step_id, pred_idx, gt_idx, sim FROM r WHERE k = 1""")
def best_resemblance(spark, d):
    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    o = objects(spark, d).select("step_id", labels.canonical(F.col("label")).alias("cls"), "idx", "feature")
    g, p = o.withColumnsRenamed({"idx": "gt_idx", "feature": "g"}), o.withColumnsRenamed({"idx": "pred_idx", "feature": "p"})
    sim = r9(dot("g", "p") / (F.sqrt(dot("g", "g")) * F.sqrt(dot("p", "p"))))
    s = g.join(p, ["step_id", "cls"]).filter("gt_idx <> pred_idx").select("step_id", "pred_idx", "gt_idx", sim.alias("sim"))
    return s.groupBy("step_id", "pred_idx").agg(F.min(F.struct((-F.col("sim")).alias("inv"), "gt_idx")).alias("x")).select("step_id", "pred_idx", "x.gt_idx", (0.0 - F.col("x.inv")).alias("sim"))


@query("q82_image_level_aggregate", f"""{W} SELECT step_id, round(count(*) FILTER (matched)::DOUBLE / count(*), 9) AS completeness, round(avg(1 - score) FILTER (matched), 9) AS quality, round(avg(sqrt((gcx - pcx) * (gcx - pcx) + (gcy - pcy) * (gcy - pcy)) / {DIAG}) FILTER (matched), 9) AS center_error,
    round(count(*) FILTER (NOT matched)::DOUBLE / count(*), 9) AS hallucination_rate, round(max(gt_depth), 9) AS max_depth FROM objects GROUP BY 1""")
def image_level(spark, d):
    def of_matched(x):
        return F.avg(F.when(F.col("matched"), x))

    dist = boxes.center_distance(F.col("gt"), F.col("pred"), HEIGHT, WIDTH)
    return objects(spark, d).groupBy("step_id").agg(
        r9(F.count_if("matched") / F.count("*")).alias("completeness"), r9(of_matched(1 - F.col("score"))).alias("quality"), r9(of_matched(dist)).alias("center_error"),
        r9(F.count_if(~F.col("matched")) / F.count("*")).alias("hallucination_rate"), r9(F.max("gt_depth")).alias("max_depth"),
    )


EXTRA_SQL = f"""extra AS (SELECT step_id, idx FROM objects e WHERE NOT matched
    AND NOT EXISTS (SELECT 1 FROM objects m WHERE m.step_id = e.step_id AND m.matched AND {iou_sql('m.p', 'e.p')} > 0.5)
    AND NOT EXISTS (SELECT 1 FROM objects g WHERE g.step_id = e.step_id AND g.idx <> e.idx AND ({iou_sql('g.g', 'e.p')} > 0.25 OR (e.pcx BETWEEN g.gx1 AND g.gx2 AND e.pcy BETWEEN g.gy1 AND g.gy2))))"""
BOX_SQL = "{'idx': o.idx, 'n': 1, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}"
_INSIDE = "(({0}x1 + {0}x2) / 2 BETWEEN {1}x1 AND {1}x2 AND ({0}y1 + {0}y2) / 2 BETWEEN {1}y1 AND {1}y2)"


@query("q91_merge_recover_extra", f"""WITH RECURSIVE {OBJECTS_SQL}, {EXTRA_SQL}, b AS (SELECT step_id, idx, px1 AS x1, py1 AS y1, px2 AS x2, py2 AS y2 FROM objects),
    bo AS (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY idx) AS k FROM b),
    merge1 AS (SELECT DISTINCT step_id, 0::BIGINT AS k, []::STRUCT(idx INT, n INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS gs FROM b
      UNION ALL SELECT w.step_id, o.k, CASE WHEN len(list_filter(gs, lambda g: {iou_sql('g.', 'o.')} > 0.3)) = 0 THEN list_append(gs, {BOX_SQL})
        ELSE list_transform(gs, lambda g: CASE WHEN g.idx = list_filter(gs, lambda h: {iou_sql('h.', 'o.')} > 0.3)[1].idx
          THEN {{'idx': g.idx, 'n': g.n + 1, 'x1': least(g.x1, o.x1), 'y1': least(g.y1, o.y1), 'x2': greatest(g.x2, o.x2), 'y2': greatest(g.y2, o.y2)}} ELSE g END) END FROM merge1 w JOIN bo o ON o.step_id = w.step_id AND o.k = w.k + 1),
    merged AS (SELECT step_id, unnest(arg_max(gs, k)) AS g FROM merge1 GROUP BY 1),
    eo AS (SELECT b.*, row_number() OVER (PARTITION BY step_id ORDER BY idx) AS k FROM b JOIN extra USING (step_id, idx)),
    extra1 AS (SELECT DISTINCT step_id, 0::BIGINT AS k, []::STRUCT(idx INT, n INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS gs FROM eo
      UNION ALL SELECT w.step_id, o.k, CASE WHEN len(list_filter(gs, lambda g: {iou_sql('g.', 'o.')} >= 0.4 OR {_INSIDE.format('o.', 'g.')} OR {_INSIDE.format('g.', 'o.')})) = 0 THEN list_append(gs, {BOX_SQL}) ELSE gs END
      FROM extra1 w JOIN eo o ON o.step_id = w.step_id AND o.k = w.k + 1),
    kept AS (SELECT step_id, unnest(arg_max(gs, k)) AS g FROM extra1 GROUP BY 1),
    near AS (SELECT m.step_id, m.idx AS gt_idx, p.idx AS idx, round(sqrt((m.gcx - p.pcx) * (m.gcx - p.pcx) + (m.gcy - p.pcy) * (m.gcy - p.pcy)) / {DIAG}, 9) AS distance, {CANON.format('m.label')} = {CANON.format('p.label')} AND 0.75::DOUBLE + 0.25 * (1 - p.score) >= 0.8 AS accepted
      FROM kept JOIN objects p ON p.step_id = kept.step_id AND p.idx = kept.g.idx JOIN objects m ON m.step_id = p.step_id AND NOT m.matched AND m.idx <> p.idx),
    no AS (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY gt_idx, distance, idx) AS k FROM near WHERE distance <= 0.35),
    back AS (SELECT DISTINCT step_id, 0::BIGINT AS k, []::INT[] AS asked, []::INT[] AS used, false AS took FROM no
      UNION ALL SELECT w.step_id, o.k, CASE WHEN list_contains(asked, gt_idx) OR list_contains(used, idx) THEN asked ELSE list_append(asked, gt_idx) END,
        CASE WHEN accepted AND NOT (list_contains(asked, gt_idx) OR list_contains(used, idx)) THEN list_append(used, idx) ELSE used END, accepted AND NOT (list_contains(asked, gt_idx) OR list_contains(used, idx)) FROM back w JOIN no o ON o.step_id = w.step_id AND o.k = w.k + 1),
    got AS (SELECT step_id, gt_idx, idx, distance FROM back JOIN no USING (step_id, k) WHERE took)
    SELECT step_id, 'merged' AS kind, NULL::INT AS gt_idx, g.idx AS idx, g.n AS n, round(g.x1, 9) AS x1, round(g.y1, 9) AS y1, round(g.x2, 9) AS x2, round(g.y2, 9) AS y2, NULL::DOUBLE AS distance FROM merged
    UNION ALL SELECT kept.step_id, CASE WHEN got.idx IS NULL THEN 'extra' ELSE 'recovered' END, got.gt_idx, g.idx, 1, round(g.x1, 9), round(g.y1, 9), round(g.x2, 9), round(g.y2, 9), got.distance FROM kept LEFT JOIN got ON got.step_id = kept.step_id AND got.idx = kept.g.idx""")
def merge_recover(spark, d):
    """Merged boxes, recovered pairs and the extras left over, one kind of row each."""
    o, box = objects(spark, d), ["x1", "y1", "x2", "y2"]
    merged = match.merge_overlapping(_detections(spark, d), tau=0.3).select("step_id", F.lit("merged").alias("kind"), F.lit(None).cast("int").alias("gt_idx"), "idx", "n", *box, F.lit(None).cast("double").alias("distance"))
    extra = match.dedupe_extras(extra_objects(spark, d).join(_detections(spark, d).select("step_id", "idx", *box), ["step_id", "idx"]))
    missing = o.filter("NOT matched").select("step_id", F.col("idx").alias("gt_idx"), F.col("label").alias("gl"), "gt")
    seen = extra.join(o.select("step_id", "idx", F.col("label").alias("pl"), "score", "pred"), ["step_id", "idx"])
    # an object and its own prediction have been told apart already
    near = missing.join(seen, "step_id").filter("gt_idx <> idx").withColumn("distance", r9(boxes.center_distance(F.col("gt"), F.col("pred"), HEIGHT, WIDTH))).filter("distance <= 0.35")
    same = labels.compatible(F.col("gl"), F.col("pl")) & (0.75 + 0.25 * (1 - F.col("score")) >= 0.8)
    got = match.recover(near.select("step_id", "gt_idx", F.col("idx").alias("pred_idx"), "distance", F.coalesce(same, F.lit(False)).alias("accepted"))).withColumnRenamed("pred_idx", "idx")
    left = extra.join(got.select("step_id", "idx", "gt_idx", "distance"), ["step_id", "idx"], "left")
    kind = F.when(F.col("gt_idx").isNull(), "extra").otherwise("recovered")
    out = merged.union(left.select("step_id", kind.alias("kind"), "gt_idx", "idx", F.lit(1).alias("n"), *box, "distance"))
    return out.withColumns({c: r9(c) for c in box})


@query("q77_protocol_guards", f"""{W} SELECT step_id, 'too_few_matched' AS rule FROM objects GROUP BY step_id HAVING NOT count(*) FILTER (matched) >= 5 UNION ALL SELECT step_id, 'low_score' FROM objects GROUP BY step_id HAVING NOT min(score) >= 0.01""")
def protocol_guards(spark, d):
    from ..operators.rules import Rule, violations

    g = objects(spark, d).groupBy("step_id").agg(F.count_if("matched").alias("m"), F.min("score").alias("s"))
    return violations(g, ["step_id"], [Rule("too_few_matched", F.expr("m >= 5")), Rule("low_score", F.expr("s >= 0.01"))]).select("step_id", "rule")


@query("q88_intrinsics_and_boxes", f"""{W} SELECT step_id, idx, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, gcx / 640)), 9) AS cx, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (gx2 - gx1) / 640)), 9) AS w,
    round(greatest(0.0::DOUBLE, gx1 - (gx2 - gx1) * 0.1::DOUBLE), 9) AS crop_x1, round(least(640.0::DOUBLE, gx2 + (gx2 - gx1) * 0.1::DOUBLE), 9) AS crop_x2, round((pred_depth - gt_depth) / greatest((abs(pred_depth) + abs(gt_depth)) / 2, 1e-8::DOUBLE), 9) AS gap FROM objects""")
def intrinsics_and_boxes(spark, d):
    from ..functions.scores import signed_gap

    o = objects(spark, d)
    unit, crop = boxes.to_center_size(F.col("gt"), HEIGHT, WIDTH), boxes.padded(F.col("gt"), 0.1, HEIGHT, WIDTH)
    return o.select("step_id", "idx", r9(unit["cx"]).alias("cx"), r9(unit["w"]).alias("w"), r9(crop["x1"]).alias("crop_x1"), r9(crop["x2"]).alias("crop_x2"), r9(signed_gap(F.col("pred_depth"), F.col("gt_depth"))).alias("gap"))


@query("q89_median_and_visibility", f"""{W}, v AS (SELECT step_id, median(gt_depth) AS med, median(gt_depth / pred_depth) FILTER (pred_depth > 0.05 AND pred_depth < 20) AS scale,
    count(*) FILTER ({iou_sql('g', 'p')} >= 0.25) AS visible FROM objects GROUP BY 1) SELECT step_id, round(med, 9) AS med, round(scale, 9) AS scale, visible FROM v""")
def median_and_visibility(spark, d):
    ok = F.col("pred_depth").between(0.05, 20)
    seen = boxes.iou(F.col("gt"), F.col("pred")) >= 0.25
    return objects(spark, d).groupBy("step_id").agg(r9(F.median("gt_depth")).alias("med"), r9(F.median(F.when(ok, F.col("gt_depth") / F.col("pred_depth")))).alias("scale"), F.count_if(seen).alias("visible"))


@query("q90_proposal_acceptance", f"""{W}, {CROSS_SQL}, c AS (SELECT step_id, g.idx AS gt_idx, p.idx AS pred_idx, 0.75::DOUBLE + 0.25 * (1 - p.score) AS conf, sqrt((g.gcx - p.pcx) * (g.gcx - p.pcx) + (g.gcy - p.pcy) * (g.gcy - p.pcy)) / {DIAG} AS dist,
      (g.label = p.label)::INT AS eq, {iou_sql('g.g', 'p.p')} AS iou FROM x), k AS (SELECT *, round(conf - 0.4 * dist + 0.1 * eq, 9) AS score FROM c WHERE conf >= 0.8 AND dist <= 0.35 AND (iou >= 0.15 OR (iou > 0 AND dist <= 0.08))),
    r AS (SELECT *, row_number() OVER (PARTITION BY step_id, gt_idx ORDER BY score DESC, pred_idx) AS n FROM k) SELECT step_id, gt_idx, pred_idx, score FROM r WHERE n = 1""")
def proposal_acceptance(spark, d):
    g, p = F.col("g"), F.col("p")
    conf, dist, iou = 0.75 + 0.25 * (1 - p["score"]), boxes.center_distance(g["gt"], p["pred"], HEIGHT, WIDTH), boxes.iou(g["gt"], p["pred"])
    c = _cross(spark, d).select("step_id", g["idx"].alias("gt_idx"), p["idx"].alias("pred_idx"), conf.alias("conf"), dist.alias("dist"), (g["label"] == p["label"]).cast("int").alias("eq"), iou.alias("iou"))
    c = c.filter("conf >= 0.8 AND dist <= 0.35 AND (iou >= 0.15 OR (iou > 0 AND dist <= 0.08))")
    score = r9(F.col("conf") - 0.4 * F.col("dist") + 0.1 * F.col("eq"))
    best = c.groupBy("step_id", "gt_idx").agg(F.min(F.struct((-score).alias("inv"), "pred_idx")).alias("x"))
    return best.select("step_id", "gt_idx", "x.pred_idx", (0.0 - F.col("x.inv")).alias("score"))


def _repeats_sql(tau: str) -> str:
    a, b, c, e = tau.split()
    return f"CASE WHEN inter / (sa + sb - inter) >= {a} THEN 'overlap' WHEN inter / sa >= {b} THEN 'covered' WHEN inter / least(sa, sb) >= {c} AND away <= {e} THEN 'contained' END"


@query("q94_label_aware_dedup", f"""WITH RECURSIVE {OBJECTS_SQL}, {QUALITY_SQL}, b AS (SELECT q.step_id, q.idx, {CANON.format('q.label')} AS cls, o.score, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS size FROM q JOIN objects o USING (step_id, idx) WHERE x2 > x1 AND y2 > y1),
    k AS (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY score DESC, size DESC, idx) AS n FROM b),
    j AS (SELECT i.step_id, i.idx, j.idx AS other, i.cls IN {match.STRUCTURAL} OR j.cls IN {match.STRUCTURAL} AS loose, i.size AS sa, j.size AS sb, greatest(0.0::DOUBLE, least(i.x2, j.x2) - greatest(i.x1, j.x1)) * greatest(0.0::DOUBLE, least(i.y2, j.y2) - greatest(i.y1, j.y1)) AS inter,
      sqrt(((i.x1 + i.x2) / 2 - (j.x1 + j.x2) / 2) ** 2 + ((i.y1 + i.y2) / 2 - (j.y1 + j.y2) / 2) ** 2) / {DIAG} AS away FROM k i JOIN k j ON i.step_id = j.step_id AND i.idx <> j.idx AND i.cls = j.cls),
    r AS (SELECT step_id, idx, other, CASE WHEN loose THEN {_repeats_sql('0.45 0.62 0.78 0.16')} ELSE {_repeats_sql('0.55 0.72 0.85 0.12')} END AS reason FROM j),
    o AS (SELECT k.step_id, k.idx, k.n, coalesce(list(r.other) FILTER (r.reason IS NOT NULL), []) AS against FROM k LEFT JOIN r ON r.step_id = k.step_id AND r.idx = k.idx GROUP BY ALL),
    walk AS (SELECT DISTINCT step_id, 0::BIGINT AS n, []::INT[] AS kept, NULL::INT AS first FROM o
      UNION ALL SELECT w.step_id, o.n, CASE WHEN list_has_any(kept, against) THEN kept ELSE list_append(kept, o.idx) END, list_filter(kept, lambda x: list_contains(against, x))[1] FROM walk w JOIN o ON o.step_id = w.step_id AND o.n = w.n + 1)
    SELECT r.step_id, r.idx, r.other AS duplicate_of, r.reason FROM walk w JOIN o USING (step_id, n) JOIN r ON r.step_id = o.step_id AND r.idx = o.idx AND r.other = w.first""")
def label_aware_dedup(spark, d):
    x = objects(spark, d).select("step_id", "idx", labels.canonical(F.col("label")).alias("cls"), "score", boxes.safe_box(F.col("gt"), HEIGHT, WIDTH).alias("b"))
    return match.dedupe_objects(x.filter("b IS NOT NULL").select("step_id", "idx", "cls", "score", "b.*"), HEIGHT, WIDTH)
