"""Order-dependent matching: suppression, one-to-one assignment, merging, recovery.

Candidates come from Catalyst joins on the step; only the greedy or optimal choice
itself is a grouped kernel.  A step has a bounded number of detections, so a group
is small.  Every kernel sorts by an explicit total order (index last).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.images import mask_iou

BOX = ["x1", "y1", "x2", "y2"]
#: Classes (by canonical name; bookcase stands for shelves) whose boxes are loose.
STRUCTURAL = ("bookcase", "cabinet", "curtain", "door", "window")


def _iou(b: np.ndarray) -> np.ndarray:
    """Exact intersection over union of all pairs of boxes."""
    w = np.minimum(b[:, None, 2], b[None, :, 2]) - np.maximum(b[:, None, 0], b[None, :, 0])
    h = np.minimum(b[:, None, 3], b[None, :, 3]) - np.maximum(b[:, None, 1], b[None, :, 1])
    inter = np.maximum(w, 0) * np.maximum(h, 0)
    size = np.maximum(b[:, 2] - b[:, 0], 0) * np.maximum(b[:, 3] - b[:, 1], 0)
    union = size[:, None] + size[None, :] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def suppress(boxes: np.ndarray, scores: np.ndarray, tau: float = 0.88, cap: int = 60) -> list[int]:
    """Kept positions: by falling score (then index), dropping what overlaps a kept box by ``tau`` or more."""
    over, kept = _iou(boxes), []
    for i in np.lexsort((np.arange(len(scores)), -scores)):
        if len(kept) == cap:
            break
        if all(over[i, j] < tau for j in kept):
            kept.append(int(i))
    return kept


def greedy_pairs(rows: list[tuple], used_left: set | None = None, used_right: set | None = None) -> list[tuple]:
    """One-to-one pairs from (left, right, score...) in the order given."""
    left, right, out = set(used_left or ()), set(used_right or ()), []
    for row in rows:
        if row[0] not in left and row[1] not in right:
            left.add(row[0])
            right.add(row[1])
            out.append(row)
    return out


def assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of greatest total weight, each row and column once (shortest augmenting paths).

    Rectangular inputs are allowed; min(rows, columns) pairs come back.
    """
    flip = weights.shape[0] > weights.shape[1]
    cost = -(weights.T if flip else weights).astype(float)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)  # row of each column; 0 is none
    for row in range(1, n + 1):
        owner[0], col = row, 0
        dist, prev, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[col]:
            done[col] = True
            free = ~done[1:]
            step = cost[owner[col] - 1] - u[owner[col]] - v[1:]
            better = free & (step < dist[1:])
            dist[1:][better], prev[1:][better] = step[better], col
            nxt = int(np.argmin(np.where(free, dist[1:], np.inf))) + 1
            delta = dist[nxt]
            u[owner[done]] += delta
            v[done] -= delta
            dist[1:][free] -= delta
            col = nxt
        while col:
            owner[col] = owner[prev[col]]
            col = prev[col]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def nms(detections: DataFrame, tau: float = 0.88, cap: int = 60, by_label: bool = False) -> DataFrame:
    """(step_id, idx, rank) of kept detections (step_id, idx, label, score, x1..y2), per step or per step and label."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        kept = suppress(pdf[BOX].to_numpy(float), pdf["score"].to_numpy(float), tau, cap)
        return pd.DataFrame({"step_id": pdf["step_id"].to_numpy()[kept], "idx": pdf["idx"].to_numpy()[kept], "rank": np.arange(len(kept), dtype=np.int32)})

    keys = ["step_id", "label"] if by_label else ["step_id"]
    return detections.groupBy(*keys).applyInPandas(run, "step_id bigint, idx int, rank int")


def greedy_match(candidates: DataFrame) -> DataFrame:
    """One-to-one pairs of (step_id, gt_idx, pred_idx, iou, similarity) candidates, best overlap first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["iou", "similarity", "gt_idx", "pred_idx"], ascending=[False, False, True, True], kind="stable")
        rows = greedy_pairs(list(pdf[["gt_idx", "pred_idx", "iou", "similarity"]].itertuples(index=False, name=None)))
        out = pd.DataFrame(rows, columns=["gt_idx", "pred_idx", "iou", "similarity"])
        out.insert(0, "step_id", pdf["step_id"].iloc[0])
        return out

    return candidates.groupBy("step_id").applyInPandas(run, "step_id bigint, gt_idx int, pred_idx int, iou double, similarity double")


def optimal_match(candidates: DataFrame, allow_unmatched: bool = True) -> DataFrame:
    """Pairs of greatest total ``weight`` among (step_id, gt_idx, pred_idx, weight); what is no candidate is never paired."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, p = np.sort(pdf["gt_idx"].unique()), np.sort(pdf["pred_idx"].unique())
        w = np.full((len(g), len(p)), -1e6)
        w[np.searchsorted(g, pdf["gt_idx"]), np.searchsorted(p, pdf["pred_idx"])] = pdf["weight"]
        if allow_unmatched:  # a column of weight zero for each row
            w = np.hstack((w, np.zeros((len(g), len(g)))))
        pairs = [(a, b) for a, b in assignment(w) if b < len(p) and w[a, b] > -5e5]
        return pd.DataFrame({"step_id": pdf["step_id"].iloc[0], "gt_idx": g[[a for a, _ in pairs]], "pred_idx": p[[b for _, b in pairs]], "weight": [w[a, b] for a, b in pairs]})

    return candidates.groupBy("step_id").applyInPandas(run, "step_id bigint, gt_idx int, pred_idx int, weight double")


def merge_overlapping(detections: DataFrame, tau: float = 0.55) -> DataFrame:
    """Boxes of a step joined, in index order, to the first group they overlap by more than ``tau``; the group's hull."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, groups = pdf.sort_values("idx", kind="stable"), []
        for idx, *b in pdf[["idx", *BOX]].itertuples(index=False, name=None):
            for grp in groups:
                if _iou(np.array([grp["box"], b]))[0, 1] > tau:
                    o = grp["box"]
                    grp["box"] = [min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3])]
                    grp["n"] += 1
                    break
            else:
                groups.append({"idx": idx, "box": list(b), "n": 1})
        return pd.DataFrame([(pdf["step_id"].iloc[0], g["idx"], g["n"], *g["box"]) for g in groups], columns=["step_id", "idx", "n", *BOX])

    return detections.groupBy("step_id").applyInPandas(run, "step_id bigint, idx int, n int, x1 double, y1 double, x2 double, y2 double")


def _centre_inside(a: np.ndarray, b: np.ndarray) -> bool:
    x, y = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    return bool(b[0] <= x <= b[2] and b[1] <= y <= b[3])


def dedupe_extras(extras: DataFrame, tau: float = 0.4) -> DataFrame:
    """Extra objects (step_id, idx, x1..y2) in index order, without those that overlap one already taken by ``tau`` or have a centre in common."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        box, kept = pdf[BOX].to_numpy(float), []
        over = _iou(box)
        for i in range(len(box)):
            if not any(over[i, j] >= tau or _centre_inside(box[i], box[j]) or _centre_inside(box[j], box[i]) for j in kept):
                kept.append(i)
        return pdf.iloc[kept][["step_id", "idx", *BOX]]

    return extras.groupBy("step_id").applyInPandas(run, "step_id bigint, idx int, x1 double, y1 double, x2 double, y2 double")


def dedupe_instances(boxes: np.ndarray, masks: list[np.ndarray], scores: np.ndarray, mask_tau: float = 0.75, box_tau: float = 0.90, cap: int = 60) -> list[int]:
    """Kept positions: by falling score, then mask area (then index), dropping what overlaps a kept one by mask or by box; empty masks are no instances."""
    area = np.array([int(np.count_nonzero(m)) for m in masks])
    over, kept = _iou(np.asarray(boxes, float).reshape(-1, 4)), []
    for i in np.lexsort((np.arange(len(scores)), -area, -np.asarray(scores, float))):
        if len(kept) == cap:
            break
        if area[i] and all(over[i, j] < box_tau and mask_iou(masks[i] > 0, masks[j] > 0) < mask_tau for j in kept):
            kept.append(int(i))
    return kept


#: Proposal modes, and the scores that a mode of both kinds gives to its sources.
MODES = {"auto": ("auto",), "detector": ("detector",), "detector_mask": ("detector_mask",), "text": ("text",), "hybrid": ("auto", "text")}
HYBRID_SCORES = {"auto": 0.90, "text": 1.00}


def proposals(mode: str, sources: dict[str, DataFrame], cap: int = 60) -> DataFrame:
    """(step_id, idx, source, rank) of the proposals (step_id, idx, label, score, mask, x1..y2) of a mode.

    A mode of one source takes it as it is, ranked by index; ``hybrid`` unites two
    under constant scores and removes what repeats a better one by mask or by box.
    An unknown mode is ``text``.
    """
    names = MODES.get(mode, MODES["text"])
    if len(names) == 1:
        rank = F.row_number().over(Window.partitionBy("step_id").orderBy("idx")) - 1
        return sources[names[0]].select("step_id", "idx", F.lit(names[0]).alias("source"), rank.cast("int").alias("rank"))
    both = None
    for name in names:
        one = sources[name].withColumns({"score": F.lit(HYBRID_SCORES[name]), "source": F.lit(name)})
        both = one if both is None else both.unionByName(one)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "idx"], kind="stable")
        kept = dedupe_instances(pdf[BOX].to_numpy(float), [np.asarray(m, bool) for m in pdf["mask"]], pdf["score"].to_numpy(float), 0.72, 0.88, cap)
        return pdf.iloc[kept][["step_id", "idx", "source"]].assign(rank=np.arange(len(kept), dtype=np.int32))

    return both.groupBy("step_id").applyInPandas(run, "step_id bigint, idx int, source string, rank int")


def gated_match(proposals: DataFrame, least: float = 0.8) -> DataFrame:
    """Every proposal (step_id, gt_idx, pred_idx, compatible, confidence) with its ``status`` (match, rejected) and ``reason``.

    Labels are gated first, then the confidence (null is 0.5); the rest is taken one to one, the most confident first.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        confidence = pdf["confidence"].astype(float).fillna(0.5).clip(0, 1)
        pdf = pdf.assign(confidence=confidence).sort_values(["confidence", "gt_idx", "pred_idx"], ascending=[False, True, True], kind="stable")
        left, right, reasons = set(), set(), []
        for g, p, ok, c in pdf[["gt_idx", "pred_idx", "compatible", "confidence"]].itertuples(index=False, name=None):
            if ok is None or pd.isna(ok) or not ok:
                reasons.append("label")
            elif c < least:
                reasons.append("confidence")
            elif g in left or p in right:
                reasons.append("one_to_one")
            else:
                left.add(g)
                right.add(p)
                reasons.append(None)
        out = pdf[["step_id", "gt_idx", "pred_idx", "confidence"]].copy()
        out["status"], out["reason"] = ["rejected" if r else "match" for r in reasons], pd.Series(reasons, index=out.index, dtype=object)
        return out

    return proposals.groupBy("step_id").applyInPandas(run, "step_id bigint, gt_idx int, pred_idx int, confidence double, status string, reason string")


def recover(missing_extra: DataFrame, cap: int = 12) -> DataFrame:
    """Missing objects taken in index order, each with the nearest extra still unused; ``cap`` a step at most.

    ``missing_extra``: (step_id, gt_idx, pred_idx, distance) of the pairs in reach, and where there is a verdict of each
    pair, ``accepted``: a missing object whose nearest unused extra isn't accepted stays missing, and the extra unused.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gt_idx", "distance", "pred_idx"], kind="stable")
        if "accepted" not in pdf:
            pdf = pdf.assign(accepted=True)
        rows, asked, used = [], set(), set()
        for g, p, distance, accepted in pdf[["gt_idx", "pred_idx", "distance", "accepted"]].itertuples(index=False, name=None):
            if len(rows) == cap:
                break
            if g in asked or p in used:
                continue
            asked.add(g)
            if accepted:
                used.add(p)
                rows.append((g, p, distance))
        out = pd.DataFrame(rows, columns=["gt_idx", "pred_idx", "distance"])
        out.insert(0, "step_id", pdf["step_id"].iloc[0])
        return out

    return missing_extra.groupBy("step_id").applyInPandas(run, "step_id bigint, gt_idx int, pred_idx int, distance double")


def demote(pairs: DataFrame) -> DataFrame:
    """A match whose verdict is negative becomes a missing object and an extra one; others stay.

    ``pairs``: (step_id, gt_idx, pred_idx, same, confidence, identity); a missing verdict keeps the match.
    """
    keep = F.coalesce(F.col("same") & (F.col("confidence") >= 0.9) & (F.col("identity") >= 0.78), F.lit(True))
    none = F.lit(None).cast("int")

    def row(status, g, p):
        return F.struct(F.lit(status).alias("status"), g.alias("gt_idx"), p.alias("pred_idx"))

    g, p = F.col("gt_idx"), F.col("pred_idx")
    parts = F.when(keep, F.array(row("match", g, p))).otherwise(F.array(row("missing", g, none), row("hallucination", none, p)))
    return pairs.select("step_id", F.explode(parts).alias("o")).select("step_id", "o.*")


def same_objects(boxes: np.ndarray, classes: list[str], loose: np.ndarray, order: np.ndarray, diagonal: float, taus: tuple = (0.55, 0.72, 0.85, 0.12), loose_taus: tuple = (0.45, 0.62, 0.78, 0.16)) -> list[tuple[int, int, str]]:
    """(dropped, kept one it repeats, reason) over boxes taken in ``order``.

    A box repeats a kept one of its class (an empty class fits all) that it overlaps
    by taus[0], that covers it by taus[1], or of which one contains the other by
    taus[2] with centres within taus[3] of the diagonal.  Where either is ``loose``
    the second set of thresholds holds.
    """
    w = np.minimum(boxes[:, None, 2], boxes[None, :, 2]) - np.maximum(boxes[:, None, 0], boxes[None, :, 0])
    h = np.minimum(boxes[:, None, 3], boxes[None, :, 3]) - np.maximum(boxes[:, None, 1], boxes[None, :, 1])
    inter = np.maximum(w, 0) * np.maximum(h, 0)
    size = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    mid = (boxes[:, :2] + boxes[:, 2:]) / 2
    away = np.linalg.norm(mid[:, None] - mid[None, :], axis=2) / diagonal
    iou = inter / (size[:, None] + size[None, :] - inter)
    tau = np.where((loose[:, None] | loose[None, :])[..., None], np.array(loose_taus), np.array(taus))
    checks = {
        "overlap": iou >= tau[..., 0],
        "covered": inter / size[:, None] >= tau[..., 1],
        "contained": (inter / np.minimum(size[:, None], size[None, :]) >= tau[..., 2]) & (away <= tau[..., 3]),
    }
    kept, dropped = [], []
    for i in order.tolist():
        for j in kept:
            reason = next((n for n, c in checks.items() if c[i, j]), None) if not classes[i] or not classes[j] or classes[i] == classes[j] else None
            if reason:
                dropped.append((i, j, reason))
                break
        else:
            kept.append(i)
    return dropped


def dedupe_objects(detections: DataFrame, height: float, width: float, structural: tuple[str, ...] = STRUCTURAL) -> DataFrame:
    """(step_id, idx, duplicate_of, reason) of detections (step_id, idx, cls, score, x1..y2) that repeat a better one of their step."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable").reset_index(drop=True)
        b = pdf[BOX].to_numpy(float)
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        order = np.lexsort((np.arange(len(b)), -area, -pdf["score"].to_numpy(float)))
        idx = pdf["idx"].to_numpy()
        found = same_objects(b, pdf["cls"].tolist(), pdf["cls"].isin(structural).to_numpy(), order, float(np.hypot(height, width)))
        return pd.DataFrame([(pdf["step_id"].iloc[0], idx[i], idx[j], r) for i, j, r in found], columns=["step_id", "idx", "duplicate_of", "reason"])

    good = detections.filter("x2 > x1 AND y2 > y1")
    return good.groupBy("step_id").applyInPandas(run, "step_id bigint, idx int, duplicate_of int, reason string")
