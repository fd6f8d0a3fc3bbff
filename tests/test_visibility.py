import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfold.functions import reproject
from stepfold.operators import visibility

SCHEMA = "id int, depth array<double>, width int, mask array<boolean>, k array<double>, to_k array<double>, pose array<double>, to_pose array<double>, to_width int, to_height int, target int"


def turned(rng, spread):
    a, b = rng.normal(scale=spread, size=2)
    ry = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]])
    rx = np.array([[1, 0, 0], [0, np.cos(b), -np.sin(b)], [0, np.sin(b), np.cos(b)]])
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = ry @ rx, rng.normal(scale=spread, size=3)
    return out


def scenes():
    rng = np.random.default_rng(3)
    for i in range(12):
        h, w, th, tw = 18, 24, 15, 20
        depth = rng.uniform(1, 4, (h, w))
        depth[rng.random((h, w)) < 0.1] = rng.choice([0, np.nan, 30])
        mask = np.zeros((h, w), bool)
        mask[4:13, 5:18] = True
        k = np.array([[20.0, 0, 12], [0, 20, 9], [0, 0, 1]]) * (np.array([[2, 1, 2], [1, 2, 2], [1, 1, 1]]) if i % 4 == 3 else 1)
        to_k = np.array([[17.0, 0, 10], [0, 17, 7.5], [0, 0, 1]]) * (np.array([[2, 1, 2], [1, 2, 2], [1, 1, 1]]) if i % 4 == 3 else 1)
        yield i, depth, mask if i % 3 else None, turned(rng, 0.2), k, turned(rng, 0.2), to_k, (th, tw)


@pytest.fixture(scope="module")
def views(spark):
    rows = [(i, d.ravel().tolist(), d.shape[1], None if m is None else m.ravel().tolist(), k.ravel().tolist(), tk.ravel().tolist(), p.ravel().tolist(), tp.ravel().tolist(), s[1], s[0], i // 4) for i, d, m, p, k, tp, tk, s in scenes()]
    flat = np.full((18, 24), 2.0).ravel().tolist()
    eye = np.eye(4).ravel().tolist()
    k = [20.0, 0.0, 12.0, 0.0, 20.0, 9.0, 0.0, 0.0, 1.0]
    rows.append((90, flat, 24, [True] * 9 + [False] * 423, k, k, eye, eye, 24, 18, 90))  # too few pixels
    rows.append((91, flat, 24, None, [0.0] * 9, k, eye, eye, 24, 18, 91))  # no inverse
    return spark.createDataFrame(rows, SCHEMA)


def pixels(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], set()).add((r["x"], r["y"]))
    return out


def test_the_same_as_the_kernel(views):
    got = pixels(visibility.carried(views))
    want = {}
    for i, d, m, p, k, tp, tk, s in scenes():
        out = reproject.carry(reproject.usable(d) if m is None else m, d, p, k, tp, tk, s)
        if out is not None:
            y, x = np.nonzero(out)
            want[i] = set(zip(x.tolist(), y.tolist(), strict=True))
    assert got == want and len(got) > 8


def test_nearest_point_wins(views):
    z = visibility.z_buffer(views)
    each = visibility.hits(views).join(z.select("id", "candidate", "x", "y", F.col("depth").alias("least")), ["id", "candidate", "x", "y"])
    assert each.filter("depth < least").count() == 0 and z.groupBy("id", "x", "y").count().filter("count > 1").count() == 0
    assert each.count() > z.count()


def test_support_and_share(spark, views):
    seen = pixels(visibility.support(views, "target"))
    for t in (0, 1, 2):
        own = [(d, p, k) for i, d, m, p, k, tp, tk, s in scenes() if i // 4 == t and m is None]
        some = views.filter(f"target = {t} AND mask IS NULL")
        ids = [r["id"] for r in some.select("id").collect()]
        one = next(x for x in scenes() if x[0] == ids[0])
        alone = visibility.support(some.filter(F.col("id") == ids[0]), "target")
        want = reproject.visible([own[0]], one[5], one[6], one[7])
        y, x = np.nonzero(want)
        assert pixels(alone).get(t, set()) == set(zip(x.tolist(), y.tolist(), strict=True))
    masks = spark.createDataFrame([(0, 7, x, y) for x in range(10) for y in range(15)], "id int, object_id int, x int, y int")
    share = visibility.visible_share(masks, visibility.support(views, "target")).first()
    assert share["area"] == 150 and abs(share["share"] - sum((x, y) in seen[0] for x in range(10) for y in range(15)) / 150) < 1e-12


def test_thinned_points(spark, monkeypatch):
    monkeypatch.setattr(visibility, "MOST", 50)
    flat = np.full((18, 24), 2.0).ravel().tolist()
    eye, k = np.eye(4).ravel().tolist(), [20.0, 0.0, 12.0, 0.0, 20.0, 9.0, 0.0, 0.0, 1.0]
    df = spark.createDataFrame([(0, flat, 24, None, k, k, eye, eye, 24, 18, 0)], SCHEMA)
    pick = np.linspace(0, 431, 50).astype(int)
    assert sorted(r["rank"] for r in visibility.hits(df).filter("candidate = 0").collect()) == list(range(50))
    got = {(r["x"], r["y"]) for r in visibility.hits(df).filter("candidate = 0").collect()}
    assert len(got) >= 45 and len(pick) == 50


def test_closing_at_the_border(spark):
    from stepfold.functions import images

    m = np.zeros((6, 9), bool)
    m[0, 0] = m[2, 3] = m[2, 5] = m[5, 8] = True
    y, x = np.nonzero(m)
    df = spark.createDataFrame([(1, 9, 6, int(a), int(b)) for a, b in zip(x, y, strict=True)], "id int, to_width int, to_height int, x int, y int")
    for r in (1, 2):
        b, a = np.nonzero(images.closed(m, r))
        assert pixels(visibility.closed(df, r))[1] == set(zip(a.tolist(), b.tolist(), strict=True))
