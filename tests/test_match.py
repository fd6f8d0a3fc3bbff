from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepfold.operators import match
from stepfold.plans import registry  # noqa: F401, I001  (it loads the modules in order)
from stepfold.plans import objects

DIR = "/root/testdata/sf0.001"


def random_boxes(seed, n):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 20, (n, 2))
    return np.hstack((a, a + rng.integers(1, 15, (n, 2)))).astype(float), rng.integers(0, 5, n) / 5


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 25), st.sampled_from([0.1, 0.5, 0.9]))
def test_suppression(seed, n, tau):
    b, s = random_boxes(seed, n)
    kept = match.suppress(b, s, tau)
    over = match._iou(b)
    assert all(over[i, j] < tau for i in kept for j in kept if i != j)
    # whatever was dropped overlaps a kept box of a higher score, or the same and a smaller index
    assert all(any(over[i, j] >= tau and (-s[j], j) < (-s[i], i) for j in kept) for i in range(n) if i not in kept)
    assert match.suppress(b, s, tau, cap=2) == kept[:2]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5), st.integers(1, 5))
def test_assignment_is_optimal(seed, n, m):
    w = np.random.default_rng(seed).integers(-9, 10, (n, m)).astype(float)
    pairs = match.assignment(w)
    assert len(pairs) == min(n, m) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    big = w if n <= m else w.T
    best = max(sum(big[i, p[i]] for i in range(big.shape[0])) for p in permutations(range(big.shape[1]), big.shape[0]))
    assert abs(sum(w[a, b] for a, b in pairs) - best) < 1e-9


def test_greedy_pairs_are_one_to_one(spark):
    cand = {(r["step_id"], r["gt_idx"], r["pred_idx"]): r["iou"] for r in objects._candidates(spark, DIR, 0.05).collect()}
    got = objects.greedy_one_to_one(spark, DIR).collect()
    for side in ("gt_idx", "pred_idx"):
        assert len({(r["step_id"], r[side]) for r in got}) == len(got)
    left, right = {(r["step_id"], r["gt_idx"]): r["iou"] for r in got}, {(r["step_id"], r["pred_idx"]): r["iou"] for r in got}
    # a candidate that was passed over lost to a pair at least as good (the query gives nine places)
    assert all(max(left.get((s, g), -1), right.get((s, p), -1)) >= round(v, 9) for (s, g, p), v in cand.items())


def test_optimal_beats_greedy(spark):
    cand = objects._candidates(spark, DIR, 0.05).selectExpr("step_id", "gt_idx", "pred_idx", "iou AS weight")
    best = match.optimal_match(cand).groupBy().sum("weight").first()[0]
    greedy = match.greedy_match(objects._candidates(spark, DIR, 0.05)).groupBy().sum("iou").first()[0]
    assert best >= greedy - 1e-9


def test_forbidden_pairs_are_never_made(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.5), (1, 1, 0, 0.9), (1, 2, 5, -0.2)], "step_id bigint, gt_idx int, pred_idx int, weight double")
    assert [(r["gt_idx"], r["pred_idx"]) for r in match.optimal_match(df).collect()] == [(1, 0)]


def test_merge_and_recover(spark):
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1.0, 0.0, 11.0, 10.0), (1, 2, 50.0, 50.0, 60.0, 60.0)], "step_id bigint, idx int, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r["idx"], r["n"], r["x2"]) for r in match.merge_overlapping(boxes).collect()) == [(0, 2, 11.0), (2, 1, 60.0)]
    near = spark.createDataFrame([(1, 0, 7, 0.3), (1, 0, 8, 0.1), (1, 1, 8, 0.05), (1, 1, 7, 0.2)], "step_id bigint, gt_idx int, pred_idx int, distance double")
    assert sorted((r["gt_idx"], r["pred_idx"]) for r in match.recover(near).collect()) == [(0, 8), (1, 7)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 15))
def test_same_objects(seed, n):
    b, s = random_boxes(seed, n)
    classes = [("a", "b", "")[i % 3] for i in range(n)]
    loose = np.arange(n) % 4 == 0
    order = np.lexsort((np.arange(n), -s))
    dropped = match.same_objects(b, classes, loose, order, 30.0)
    gone = {i for i, _, _ in dropped}
    over, place = match._iou(b), {int(i): k for k, i in enumerate(order)}
    for i, j, _ in dropped:
        assert j not in gone and place[j] < place[i] and (classes[i] == classes[j] or not classes[i] or not classes[j])
    for i in set(range(n)) - gone:
        for j in set(range(n)) - gone:
            if i != j and (classes[i] == classes[j] or not classes[i] or not classes[j]):
                assert over[i, j] < (0.45 if loose[i] or loose[j] else 0.55)


def test_extras_are_deduplicated_as_they_come(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1.0, 0.0, 11.0, 10.0), (1, 2, 4.0, 4.0, 6.0, 6.0), (1, 3, 50.0, 50.0, 60.0, 60.0), (2, 0, 0.0, 0.0, 1.0, 1.0)]
    extras = spark.createDataFrame(rows, "step_id bigint, idx int, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r["step_id"], r["idx"]) for r in match.dedupe_extras(extras).collect()) == [(1, 0), (1, 3), (2, 0)]


def test_recovery_asks_the_nearest_only(spark):
    near = spark.createDataFrame([(1, 0, 7, 0.1, False), (1, 0, 8, 0.2, True), (1, 1, 7, 0.3, True)], "step_id bigint, gt_idx int, pred_idx int, distance double, accepted boolean")
    assert [(r["gt_idx"], r["pred_idx"]) for r in match.recover(near).collect()] == [(1, 7)]


def test_gated_match_keeps_what_it_rejects(spark):
    rows = [(1, 0, 0, True, 0.9), (1, 0, 1, True, 0.95), (1, 1, 0, False, 0.99), (1, 2, 2, True, 0.7), (1, 3, 3, True, None)]
    df = spark.createDataFrame(rows, "step_id bigint, gt_idx int, pred_idx int, compatible boolean, confidence double")
    got = {(r["gt_idx"], r["pred_idx"]): (r["status"], r["reason"]) for r in match.gated_match(df).collect()}
    assert got == {(0, 1): ("match", None), (0, 0): ("rejected", "one_to_one"), (1, 0): ("rejected", "label"), (2, 2): ("rejected", "confidence"), (3, 3): ("rejected", "confidence")}


def test_instances_are_dropped_by_mask_or_box():
    masks = [np.zeros((20, 20), bool) for _ in range(4)]
    masks[0][:10, :10] = masks[1][:10, :9] = masks[2][12:, 12:] = True
    far = np.array([[0, 0, 10, 10], [0, 0, 4, 4], [12, 12, 20, 20], [0, 0, 1, 1]], float)
    assert match.dedupe_instances(far, masks, np.array([0.9, 0.8, 0.7, 1.0])) == [0, 2]  # by mask; the empty one is none
    masks[1][:] = False
    masks[1][5, 15] = True
    assert match.dedupe_instances(far, masks, np.array([0.9, 0.8, 0.7, 1.0])) == [0, 1, 2]
    far[1] = far[0]
    assert match.dedupe_instances(far, masks, np.array([0.9, 0.8, 0.7, 1.0])) == [0, 2]  # by box


def test_merge_recover_query(spark):
    from stepfold.plans import objects

    rows = objects.merge_recover(spark, "/root/testdata/sf0.001").collect()
    assert {r["kind"] for r in rows} >= {"merged", "extra"} and all((r["gt_idx"] is not None) == (r["kind"] == "recovered") for r in rows)
    assert all(r["distance"] <= 0.35 and r["gt_idx"] != r["idx"] for r in rows if r["kind"] == "recovered")


def test_policies_are_dispatched(spark):
    from stepfold.operators import verdicts

    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    truth = spark.createDataFrame([(1, 0, "chair", (0.0, 0.0, 10.0, 10.0), [1.0, 0.0]), (1, 1, "sofa", (50.0, 0.0, 60.0, 10.0), [0.0, 1.0]), (1, 2, "bed", (0.0, 50.0, 9.0, 60.0), None)], f"step_id bigint, gt_idx int, label string, box {box}, feature array<double>")
    found = spark.createDataFrame([(1, 0, "chair", (0.0, 0.0, 10.0, 9.0), [0.0, 1.0]), (1, 1, "couch", (52.0, 0.0, 62.0, 10.0), [1.0, 0.01]), (1, 2, "bed", (0.0, 50.0, 9.0, 60.0), [0.0, 0.0])], f"step_id bigint, pred_idx int, label string, box {box}, feature array<double>")

    def pairs(policy, **options):
        return sorted((r["gt_idx"], r["pred_idx"]) for r in verdicts.match_by(policy, truth, found, 100, 100, **options).collect())

    assert pairs("strict") == [(0, 0), (2, 2)] and pairs("verdict") == pairs("strict")
    assert (1, 1) in pairs("relaxed") or pairs("relaxed") == pairs("strict")
    # by appearance the two change places, if they may lie that far apart; what has no feature stays alone
    assert pairs("assignment") == [] and pairs("assignment", reach=0.6) == [(0, 1), (1, 0)]
    told = spark.createDataFrame([(1, 0, 1, True, 0.9), (1, 1, 1, True, 0.85), (1, 2, 2, False, 1.0)], "step_id bigint, gt_idx int, pred_idx int, compatible boolean, confidence double")
    assert pairs("verdict", proposals=told) == [(0, 1)]
    with pytest.raises(ValueError):
        pairs("other")
