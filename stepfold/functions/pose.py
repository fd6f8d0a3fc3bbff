"""Camera motion as Column functions.

A rotation is a list of nine Columns by rows, a position a list of three, so that
all of it stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list[Column]


def yaw_pitch(yaw: Column, pitch: Column) -> Vector:
    """R_y(yaw) R_x(pitch)."""
    cy, sy, cp, sp = F.cos(yaw), F.sin(yaw), F.cos(pitch), F.sin(pitch)
    zero = F.lit(0.0)
    return [cy, sy * sp, sy * cp, zero, cp, -sp, -sy, cy * sp, cy * cp]


def transposed_times(a: Vector, b: Vector) -> Vector:
    """A^T B of two 3x3 matrices."""
    return [sum((a[3 * k + i] * b[3 * k + j] for k in range(1, 3)), a[i] * b[j]) for i in range(3) for j in range(3)]


def norm(v: Vector) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def determinant(m: Vector) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def rotation_angle(r: Vector) -> Column:
    cos = (r[0] + r[4] + r[8] - 1) / 2
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def relative_motion(r0: Vector, c0: Vector, r1: Vector, c1: Vector) -> dict[str, Column | Vector]:
    """Motion from one camera-to-world pose to another, seen from the first."""
    d = [b - a for a, b in zip(c0, c1, strict=True)]
    t = [r0[i] * d[0] + r0[3 + i] * d[1] + r0[6 + i] * d[2] for i in range(3)]
    r = transposed_times(r0, r1)
    x, y, z = r[2], r[5], r[8]
    return {
        "t": t,
        "r": r,
        "tx": t[0],
        "ty": t[1],
        "tz": t[2],
        "translation_norm": norm(t),
        "yaw": F.degrees(F.atan2(x, z)),
        "pitch": F.degrees(F.atan2(y, F.sqrt(x * x + z * z))),
        "rotation_angle": rotation_angle(r),
    }


def cosine(a: Vector, b: Vector, eps: float = 1e-8) -> Column:
    """Null where a vector has no direction."""
    return F.when((norm(a) >= eps) & (norm(b) >= eps), dot(a, b) / (norm(a) * norm(b)))


def angle_between(a: Vector, b: Vector) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))))


def direction_label(x: Column, eps: Column) -> Column:
    return F.when(x.isNull(), None).when(F.abs(x) <= eps, "zero").when(x > 0, "positive").otherwise("negative")


def direction_correct(pred: Column, expected: Column, unit: Column) -> Column:
    """1 or 0; null where nothing moves that should."""
    eps = F.when(unit == "m", 1e-3).otherwise(1e-2)
    want, got = direction_label(expected, eps), direction_label(pred, eps)
    return F.when((want != "zero") & got.isNotNull(), (want == got).cast("double"))


def action_component(action: Column, motion: dict[str, Column], subtype: Column | None = None) -> dict[str, Column]:
    """Name, value and unit of the component an action is about; the subtype counts only without an action."""
    action = F.lower(F.coalesce(action, F.lit("")))
    # Actions and subtype words of each component, in order of precedence.
    rules = [
        (["forward", "backward"], ["forward_backward"], "tz_forward_m", "tz", "m"),
        (["left", "right", "strafe_left", "strafe_right", "lateral"], ["lateral"], "tx_right_m", "tx", "m"),
        (["up", "down", "vertical_up", "vertical_down"], ["vertical"], "ty_down_m", "ty", "m"),
        (["pitch_up", "pitch_down"], ["pitch"], "pitch_deg", "pitch", "deg"),
        (["yaw_left", "yaw_right", "turn_left", "turn_right"], ["yaw", "rotation"], "yaw_deg", "yaw", "deg"),
    ]
    picked = F.lit(None).cast("int")
    if subtype is not None:
        low = F.lower(F.coalesce(subtype, F.lit("")))
        for k, (_, words, *_) in reversed(list(enumerate(rules))):
            hit = low.contains(words[0]) if len(words) == 1 else low.contains(words[0]) | low.contains(words[1])
            picked = F.when(hit, k).otherwise(picked)
        picked = F.when(action == "", picked)
    for k, (names, *_) in enumerate(rules):
        picked = F.when(action.isin(names), k).otherwise(picked)

    def choose(values):
        out = F.lit(None)
        for k, v in enumerate(values):
            out = F.when(picked == k, v).otherwise(out)
        return out

    return {"component": choose([F.lit(r[2]) for r in rules]), "value": choose([motion[r[3]] for r in rules]), "unit": choose([F.lit(r[4]) for r in rules])}


def ground_delta(f0: Vector, c0: Vector, f1: Vector, c1: Vector) -> dict[str, Column]:
    """Motion over the ground: forward vectors f and centres c, z upwards."""

    def flat(v):
        n = F.sqrt(v[0] * v[0] + v[1] * v[1]) + 1e-8
        return [v[0] / n, v[1] / n], n

    def signed(a, b):
        na, nb = F.sqrt(a[0] * a[0] + a[1] * a[1]), F.sqrt(b[0] * b[0] + b[1] * b[1])
        cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a[0] * b[0] + a[1] * b[1]) / (na * nb)))
        cross = a[0] * b[1] - a[1] * b[0]
        angle = F.degrees(F.acos(cos)) * F.when(cross > 0, -1.0).otherwise(1.0)
        return F.when((na == 0) | (nb == 0), 0.0).otherwise(angle)

    d0, n0 = flat(f0)
    d1, n1 = flat(f1)
    move = [c1[0] - c0[0], c1[1] - c0[1]]
    distance = F.sqrt(move[0] * move[0] + move[1] * move[1])
    angle = F.when(distance > 1e-6, signed(d0, move)).otherwise(0.0)
    return {
        "dx": distance * F.sin(F.radians(angle)),
        "dy": distance * F.cos(F.radians(angle)),
        "dz": c1[2] - c0[2],
        "dangle": signed(d0, d1),
        "dphi": F.degrees(F.atan2(f1[2], n1) - F.atan2(f0[2], n0)),
    }
