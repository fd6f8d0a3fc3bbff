"""Verdict queries: detector filters, match policies, diagnosis, overlays and defect counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes, labels
from ..operators import match, verdicts
from .fixtures import HEIGHT, OBJECTS_SQL, WIDTH, iou_sql, objects
from .objects import CANON, CROSS_SQL, DIAG, W, _assignment_sql
from .registry import query, r9

R = f"WITH RECURSIVE {OBJECTS_SQL}"
SAFE_SQL = """safe AS (SELECT step_id, idx, label, score, greatest(0.0::DOUBLE, least(639.0::DOUBLE, round_even(px1, 0))) AS x1, greatest(0.0::DOUBLE, least(639.0::DOUBLE, round_even(px2, 0))) AS x2,
   greatest(0.0::DOUBLE, least(479.0::DOUBLE, round_even(py1, 0))) AS y1, greatest(0.0::DOUBLE, least(479.0::DOUBLE, round_even(py2, 0))) AS y2 FROM objects)"""


def greedy_sql(candidates: str, order: str) -> str:
    """CTEs ``k`` and ``walk``: candidates (grp, gt_idx, pred_idx, ...) taken one to one in an order; rows that are taken have ``took``."""
    return f"""k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {order}) AS n FROM ({candidates})),
    walk AS (SELECT DISTINCT grp, 0::BIGINT AS n, []::INT[] AS gs, []::INT[] AS ps, false AS took FROM k
      UNION ALL SELECT w.grp, k.n, CASE WHEN list_contains(gs, gt_idx) OR list_contains(ps, pred_idx) THEN gs ELSE list_append(gs, gt_idx) END,
        CASE WHEN list_contains(gs, gt_idx) OR list_contains(ps, pred_idx) THEN ps ELSE list_append(ps, pred_idx) END, NOT (list_contains(gs, gt_idx) OR list_contains(ps, pred_idx))
      FROM walk w JOIN k ON k.grp = w.grp AND k.n = w.n + 1)"""


def _found(spark, d):
    return objects(spark, d).select("step_id", F.col("idx").alias("pred_idx"), "label", F.col("pred").alias("box"), "score")


def _truth(spark, d):
    return objects(spark, d).select("step_id", F.col("idx").alias("gt_idx"), "label", F.col("gt").alias("box"), "matched")


@query("q95_detector_box_validity", f"{W}, {SAFE_SQL} SELECT step_id, idx AS pred_idx, x1, y1, x2, y2 FROM safe WHERE score >= 0.05 AND x2 > x1 AND y2 > y1 AND (x2 - x1) * (y2 - y1) BETWEEN 92 AND 9000")
def detector_box_validity(spark, d):
    # a lower upper limit than the default, so that both limits act on these boxes
    good = verdicts.valid_boxes(_found(spark, d), HEIGHT, WIDTH, score=0.05, most=9000 / (HEIGHT * WIDTH))
    return good.select("step_id", "pred_idx", "box.*")


@query("q96_score_fallback", f"{W}, m AS (SELECT step_id, idx, score, max(score) OVER (PARTITION BY step_id, label) AS best, label FROM objects) SELECT step_id, label, idx, round(score, 9) AS score FROM m WHERE score >= 0.12 OR best < 0.12")
def score_fallback(spark, d):
    o = objects(spark, d).select("step_id", "label", "idx", "score", F.struct("step_id", "label").alias("k"))
    return verdicts.score_filter(o, 0.12, "k").select("step_id", "label", "idx", r9("score").alias("score"))


def _records(spark, d):
    o, n = objects(spark, d), F.col("idx")
    status = F.when(F.col("matched"), "match").when(F.col("step_id") % 2 == 0, "hallucination").otherwise("missing")
    verdict = F.struct(F.when(n % 3 != 0, F.col("score")).alias("severity"), F.when(n != 7, F.col("score") < 0.15).alias("well_formed"), F.when(n == 2, "vlm_unparsed").alias("note"))
    return o.select("step_id", "idx", status.alias("status"), F.when(n % 4 != 3, verdict).alias("verdict"))


@query("q97_defect_summary", f"""{W}, r AS (SELECT step_id, CASE WHEN matched THEN 'match' WHEN step_id % 2 = 0 THEN 'hallucination' ELSE 'missing' END AS status, idx % 4 <> 3 AS told, CASE WHEN idx % 3 <> 0 THEN score END AS severity,
    CASE WHEN idx <> 7 THEN score < 0.15 END AS good, idx = 2 AS unread FROM objects)
    SELECT step_id, round(avg(severity) FILTER (told), 9) AS mean_severity, count(*) FILTER (told AND NOT good) AS defective, count(*) FILTER (told AND NOT good AND status = 'match') AS defective_matched,
      count(*) FILTER (told AND NOT good AND status = 'hallucination') AS defective_extra, count(*) FILTER (told AND unread) AS unparsed FROM r GROUP BY 1""")
def defect_summary(spark, d):
    return verdicts.defect_summary(_records(spark, d)).withColumn("mean_severity", r9("mean_severity"))


POLICY_SQL = " UNION ALL ".join(
    f"SELECT '{name}_' || x.step_id AS grp, '{name}' AS policy, x.step_id, g.idx AS gt_idx, p.idx AS pred_idx, {iou_sql('g.g', 'p.p', 1e-6)} AS iou FROM x WHERE {CANON.format('g.label') if syn else 'g.label'} = {CANON.format('p.label') if syn else 'p.label'} AND {iou_sql('g.g', 'p.p', 1e-6)} >= {tau}"
    for name, (tau, syn) in verdicts.POLICIES.items()
)


@query("q98_match_policies", f"{R}, {CROSS_SQL}, {greedy_sql(POLICY_SQL, 'round(iou, 9) DESC, gt_idx, pred_idx')} SELECT k.policy, k.step_id, k.gt_idx, k.pred_idx, round(k.iou, 9) AS iou FROM walk JOIN k USING (grp, n) WHERE took")
def match_policies(spark, d):
    out = None
    for name in verdicts.POLICIES:
        c = verdicts.policy_candidates(_truth(spark, d).drop("matched"), _found(spark, d).drop("score"), name).withColumn("iou", r9("iou"))
        one = match.greedy_match(c.withColumn("similarity", F.lit(0.0))).select(F.lit(name).alias("policy"), "step_id", "gt_idx", "pred_idx", "iou")
        out = one if out is None else out.unionAll(one)
    return out


COSINE_SQL = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, (list_cosine_similarity(g.feature, list_concat(p.feature[2:], p.feature[1:1])) + 1) / 2))"
CENTRE_SQL = f"sqrt((g.gcx - p.pcx) * (g.gcx - p.pcx) + (g.gcy - p.pcy) * (g.gcy - p.pcy)) / {DIAG}"


def _with_feature(spark, d, other: bool):
    """Objects with features; those of detections are moved on by one place, so that no two pairs are equally alike."""
    feature = F.concat(F.slice("feature", 2, 31), F.slice("feature", 1, 1)) if other else F.col("feature")
    return objects(spark, d).select("step_id", F.col("idx").alias("pred_idx" if other else "gt_idx"), F.col("pred" if other else "gt").alias("box"), feature.alias("feature"))


@query(
    "q133_appearance_assignment",
    f"""{W}, {CROSS_SQL}, cand AS (SELECT step_id, g.idx AS gt_idx, p.idx AS pred_idx, {COSINE_SQL} AS sim, {COSINE_SQL} - 0.52::DOUBLE + 1e-12::DOUBLE AS weight FROM x WHERE {COSINE_SQL} >= 0.52 AND {CENTRE_SQL} <= 0.1 AND g.idx <> p.idx),
    {_assignment_sql()}, best AS (SELECT step_id, unnest(arg_max(path, total)) AS x FROM f10 GROUP BY 1)
    SELECT step_id, x.gt_idx AS gt_idx, x.pred_idx AS pred_idx, round(c.sim, 9) AS similarity, row_number() OVER (PARTITION BY step_id ORDER BY c.sim DESC, c.gt_idx, c.pred_idx)::INT AS rank
    FROM best b JOIN cand c USING (step_id) WHERE c.gt_idx = b.x.gt_idx AND c.pred_idx = b.x.pred_idx""",
)
def appearance_assignment(spark, d):
    """An object's own detection is left out and both floors are set low, so that there is something to choose."""
    some = verdicts.appearance_candidates(_with_feature(spark, d, False), _with_feature(spark, d, True), HEIGHT, WIDTH, 0.52, 0.1).filter("gt_idx <> pred_idx")
    chosen = match.optimal_match(some.select("step_id", "gt_idx", "pred_idx", "weight")).drop("weight").join(some, ["step_id", "gt_idx", "pred_idx"])
    rank = F.row_number().over(Window.partitionBy("step_id").orderBy(F.desc("similarity"), "gt_idx", "pred_idx"))
    return chosen.select("step_id", "gt_idx", "pred_idx", r9("similarity").alias("similarity"), rank.alias("rank"))


PROPOSED_SQL = f"SELECT step_id AS grp, step_id, g.idx AS gt_idx, p.idx AS pred_idx, round(coalesce(CASE WHEN (g.idx + p.idx) % 5 <> 0 THEN 1 - {CENTRE_SQL} END, 0.5::DOUBLE), 9) AS confidence, {CANON.format('g.label')} = {CANON.format('p.label')} AS compatible FROM x"


@query(
    "q134_gated_matches",
    f"""{R}, {CROSS_SQL}, {greedy_sql(f"SELECT * FROM ({PROPOSED_SQL}) WHERE compatible AND confidence >= 0.8", 'confidence DESC, gt_idx, pred_idx')}, every AS ({PROPOSED_SQL})
    SELECT e.step_id, e.gt_idx, e.pred_idx, e.confidence, CASE WHEN w.took THEN 'match' ELSE 'rejected' END AS status,
      CASE WHEN w.took THEN NULL WHEN NOT e.compatible THEN 'label' WHEN e.confidence < 0.8 THEN 'confidence' ELSE 'one_to_one' END AS reason
    FROM every e LEFT JOIN k ON k.grp = e.step_id AND k.gt_idx = e.gt_idx AND k.pred_idx = e.pred_idx LEFT JOIN walk w ON w.grp = k.grp AND w.n = k.n""",
)
def gated_matches(spark, d):
    """All pairs of a step as a judge's proposals, with what becomes of each."""
    o = objects(spark, d)
    g = o.select("step_id", F.col("idx").alias("gt_idx"), F.col("label").alias("gl"), "gt")
    p = o.select("step_id", F.col("idx").alias("pred_idx"), F.col("label").alias("pl"), "pred")
    near = 1 - boxes.center_distance(F.col("gt"), F.col("pred"), HEIGHT, WIDTH)
    told = F.when((F.col("gt_idx") + F.col("pred_idx")) % 5 != 0, F.round(near, 9))
    all_ = g.join(p, "step_id").select("step_id", "gt_idx", "pred_idx", labels.compatible(F.col("gl"), F.col("pl")).alias("compatible"), told.alias("confidence"))
    return match.gated_match(all_)


def _best_sql(name: str, where: str) -> str:
    return f"""{name}1 AS (SELECT step_id, g.idx AS gt_idx, p.idx AS pred_idx, p.label AS label, {CANON.format('g.label')} = {CANON.format('p.label')} AS label_ok, {iou_sql('g.g', 'p.p')} AS iou,
      sqrt((g.gcx - p.pcx) * (g.gcx - p.pcx) + (g.gcy - p.pcy) * (g.gcy - p.pcy)) / {DIAG} AS centre FROM x WHERE NOT g.matched AND {where}),
    {name} AS (SELECT *, round_even(iou, 3) AS i, round_even(centre, 3) AS c, row_number() OVER (PARTITION BY step_id, gt_idx ORDER BY round(iou - 0.3 * centre, 9) DESC, pred_idx) AS k FROM {name}1)"""


@query("q99_missing_diagnosis", f"""{W}, {CROSS_SQL}, {_best_sql('r', 'p.step_id % 11 <> 0')}, {_best_sql('f', 'p.score >= 0.08 AND p.step_id % 11 <> 0')}
    SELECT o.step_id, o.idx AS gt_idx, r.pred_idx, r.i AS iou, r.c AS centre, CASE WHEN r.step_id IS NULL THEN 'no_detections' WHEN r.i < 0.05 AND r.c > 0.25 THEN 'not_near'
      WHEN r.i >= 0.05 AND (f.step_id IS NULL OR f.i < 0.35) THEN CASE WHEN NOT r.label_ok THEN 'label' WHEN r.i < 0.35 THEN 'overlap' ELSE 'filtered' END ELSE 'contended' END AS reason
    FROM objects o LEFT JOIN r ON r.step_id = o.step_id AND r.gt_idx = o.idx AND r.k = 1 LEFT JOIN f ON f.step_id = o.step_id AND f.gt_idx = o.idx AND f.k = 1 WHERE NOT o.matched""")
def missing_diagnosis(spark, d):
    # steps without any detection are made by leaving those of every eleventh step out
    raw = _found(spark, d).filter("step_id % 11 <> 0")
    found = verdicts.diagnose_missing(_truth(spark, d).filter("NOT matched"), raw, raw.filter("score >= 0.08"), HEIGHT, WIDTH)
    return found.select("step_id", "gt_idx", "raw.pred_idx", "raw.iou", "raw.centre", "reason")


@query("q100_verdicts_and_overlay", f"""{W}, v AS (SELECT step_id, idx, CASE WHEN idx % 4 = 1 THEN NULL ELSE score < 0.15 END AS same, CASE WHEN idx % 2 = 0 THEN 1.5::DOUBLE * score END AS conf, idx % 3 <> 0 AS asked, label <> 'tv' AS formed, score < 0.1 AS good FROM objects)
    SELECT step_id, idx AS gt_idx, CASE WHEN asked AND same IS NOT NULL THEN same ELSE false END AS same, round(CASE WHEN asked AND same IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(conf, 0.5::DOUBLE))) ELSE 0.0::DOUBLE END, 9) AS confidence,
      asked AND same IS NOT NULL AS answered, formed AND (NOT asked OR good) AS well_formed FROM v""")
def verdicts_and_overlay(spark, d):
    o, n = objects(spark, d), F.col("idx")
    key = ["step_id", "gt_idx", "pred_idx"]
    pairs = o.select("step_id", n.alias("gt_idx"), n.alias("pred_idx"), (F.col("label") != "tv").alias("well_formed"))
    said = o.filter("idx % 3 <> 0").select("step_id", n.alias("gt_idx"), n.alias("pred_idx"), F.when(n % 4 != 1, F.col("score") < 0.15).alias("same"), F.when(n % 2 == 0, 1.5 * F.col("score")).alias("confidence"), (F.col("score") < 0.1).alias("well_formed"))
    both = verdicts.overlay(verdicts.with_verdicts(pairs, said, fail_open=False), said, key)
    return both.select("step_id", "gt_idx", "same", r9("confidence").alias("confidence"), "answered", "well_formed")


@query("q101_best_refined_instance", f"""{W}, {CROSS_SQL}, c AS (SELECT step_id, g.idx AS prompt_idx, p.idx AS idx, round(coalesce(CASE WHEN p.idx <> 4 THEN p.score END, 1.0::DOUBLE) + {iou_sql('g.g', 'p.p')}, 9) AS quality FROM x
      WHERE {iou_sql('g.g', 'p.p')} > 0.01 AND (p.px2 - p.px1) * (p.py2 - p.py1) >= 4000), r AS (SELECT *, row_number() OVER (PARTITION BY step_id, prompt_idx ORDER BY quality DESC, idx) AS k FROM c) SELECT step_id, prompt_idx, idx, quality FROM r WHERE k = 1""")
def best_refined_instance(spark, d):
    prompts = _truth(spark, d).select("step_id", F.col("gt_idx").alias("prompt_idx"), "box")
    found = _found(spark, d).select("step_id", F.col("pred_idx").alias("idx"), "box", F.when(F.col("pred_idx") != 4, F.col("score")).alias("score"), boxes.area(F.col("box")).alias("area"))
    return verdicts.best_refined(prompts, found, least_area=4000)


@query("q102_morphology", f"""{W}, m AS (SELECT step_id, idx, CASE WHEN idx = 9 THEN 0.0::DOUBLE ELSE (gx2 - gx1) * (gy2 - gy1) END AS ga, (gx2 - gx1) / (gy2 - gy1 + 1e-6::DOUBLE) AS gr, CASE WHEN idx = 8 THEN 0.0::DOUBLE ELSE (px2 - px1) * (py2 - py1) END AS pa, (px2 - px1) / (py2 - py1 + 1e-6::DOUBLE) AS pr FROM objects)
    SELECT step_id, idx, CASE WHEN ga <> 0 THEN round(0.5::DOUBLE * abs(1 - pa / (ga + 1e-6::DOUBLE)) + 0.5::DOUBLE * abs(CASE WHEN pa > 0 THEN pr ELSE 0 END - gr), 9) END AS deviation FROM m""")
def morphology(spark, d):
    def shape(b, empty):
        return F.when(F.col("idx") == empty, 0.0).otherwise(boxes.area(b)), (b["x2"] - b["x1"]) / (b["y2"] - b["y1"] + 1e-6)

    g, p = shape(F.col("gt"), 9), shape(F.col("pred"), 8)
    return objects(spark, d).select("step_id", "idx", r9(verdicts.morphology(*g, *p)).alias("deviation"))
