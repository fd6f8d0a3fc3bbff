import random

from pyspark.sql import functions as F

from stepfold.operators import grid

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def rectangles(n, extent, seed, large=0.1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w, h = (rng.choice([0, 5, 64, 300, 9000]) if rng.random() < large else rng.uniform(5, 60) for _ in range(2))
        x, y = rng.uniform(-extent, extent), rng.uniform(-extent, extent)
        if rng.random() < 0.2:  # on the lines between cells
            x, y = 64.0 * round(x / 64), 64.0 * round(y / 64)
        out.append((i, i % 3 if i % 17 else None, (x, y, x + w, y + h)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, f"id int, step int, at {BOX}")


def touch(a, b):
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def test_all_pairs_that_touch_once(spark):
    a, b = rectangles(150, 900, 1), rectangles(130, 900, 2)
    odd = [(900, 1, None), (901, 1, (float("nan"), 0.0, 1.0, 1.0)), (902, 1, (0.0, 0.0, float("inf"), 1.0))]
    for cell in (16.0, 64.0, 1000.0):
        got = grid.meeting(frame(spark, a + odd), frame(spark, b + odd), ["step"], "at", "at", cell)
        pairs = sorted((r["l"]["id"], r["r"]["id"]) for r in got.collect())
        assert pairs == sorted((i, j) for i, s, x in a for j, t, y in b if s is not None and s == t and touch(x, y))
    none = frame(spark, [])
    assert grid.meeting(none, none, ["step"], "at", "at").count() == 0


def test_pairs_looked_at_grow_in_proportion(spark):
    """Of one step's detections over a growing area."""
    looked = []
    for n in (500, 2000):
        rows = [(i, 0, x) for i, _, x in rectangles(n, 20 * n**0.5, 5, 0)]
        a = grid.placed(grid._corners(frame(spark, rows), ["step"], "at", 64.0, "l"), [0], 64.0, "l")
        b = grid.placed(grid._corners(frame(spark, rows), ["step"], "at", 64.0, "r"), [0], 64.0, "r")
        looked.append(a.join(b, ["step", "level", "cx", "cy"]).count())
    assert looked[1] < 6 * looked[0] and looked[1] < 2000 * 2000 / 20


def test_hull_of_swapped_corners(spark):
    df = spark.createDataFrame([((5.0, 9.0, 1.0, 2.0), (0.0, 3.0, 4.0, 4.0))], f"a {BOX}, b {BOX}")
    assert tuple(df.select(grid.hull(F.col("a"), F.col("b")).alias("h")).first()["h"]) == (0.0, 2.0, 5.0, 9.0)
    assert tuple(df.select(grid.hull(F.col("a")).alias("h")).first()["h"]) == (1.0, 2.0, 5.0, 9.0)
