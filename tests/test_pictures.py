import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfold.functions import images
from stepfold.operators import pictures

RNG = np.random.default_rng(8)
H, W = 13, 17


def rows(spark, many, names):
    out = [(k, x, y, *(float(p[y, x]) for p in planes)) for k, planes in enumerate(many) for y in range(planes[0].shape[0]) for x in range(planes[0].shape[1])]
    return spark.createDataFrame(out, "id int, x int, y int, " + ", ".join(f"{n} double" for n in names))


def plain(a, across, down):
    out = np.zeros((max(i for i, *_ in down) + 1, max(i for i, *_ in across) + 1))
    for i, y, v in down:
        for j, x, w in across:
            out[i, j] += v * w * a[y, x]
    return out


@pytest.mark.parametrize(("kind", "to", "antialias"), [("nearest", (9, 20), False), ("area", (5, 4), False), ("bilinear", (30, 7), False), ("cubic", (9, 26), False), ("cubic", (6, 5), True), ("bilinear", (4, 4), True)])
def test_resizing_by_a_plain_loop(spark, kind, to, antialias):
    many = [(RNG.uniform(0, 255, (H, W)),) for _ in range(2)]
    got = pictures.resized(rows(spark, many, ["value"]), (W, H), to, kind, antialias).collect()
    assert len(got) == 2 * to[0] * to[1]
    want = [plain(a, pictures.taps(W, to[0], kind, antialias), pictures.taps(H, to[1], kind, antialias)) for (a,) in many]
    assert all(abs(r["value"] - want[r["id"]][r["y"], r["x"]]) < 1e-9 for r in got)


def test_taps():
    for kind in ("nearest", "area", "bilinear", "cubic", "blur"):
        for n, to in ((7, 7), (1, 3), (10, 4), (4, 10)):
            some = pictures.taps(n, n if kind == "blur" else to, kind)
            sums = np.bincount([i for i, *_ in some], [w for *_, w in some])
            assert np.allclose(sums, 1) and {j for _, j, _ in some} <= set(range(n))
    a = RNG.uniform(0, 255, (8, 6))
    assert np.allclose(plain(a, pictures.taps(6, 3, "area"), pictures.taps(8, 4, "area")), images.half_size(a))
    assert np.allclose(plain(a, pictures.taps(6, 3), pictures.taps(8, 4)), images.half_size(a))
    assert np.array_equal(plain(a, pictures.taps(6, 4, "nearest"), pictures.taps(8, 5, "nearest")), images.resized(a, (5, 4)))
    with pytest.raises(ValueError):
        pictures.taps(3, 3, "other")


def test_structural_similarity(spark):
    many = []
    for k in range(4):
        a = RNG.integers(0, 256, (H, W)).astype(float)
        many.append((a, a if k == 0 else np.clip(a + RNG.normal(scale=20 * k, size=(H, W)), 0, 255)))
    got = {r["id"]: r["ssim"] for r in pictures.ssim(rows(spark, many, ["a", "b"]), (W, H)).collect()}
    assert all(abs(got[k] - images.ssim(a, b)) < 1e-9 for k, (a, b) in enumerate(many)) and abs(got[0] - 1) < 1e-12


def test_colour_similarity(spark):
    many = [tuple(RNG.integers(0, 256, (H, W)) for _ in range(3)) for _ in range(4)]
    other = [tuple(np.clip(p + RNG.integers(-30, 30, (H, W)), 0, 255) for p in planes) for planes in many[:2]] + [tuple(np.zeros((H, W)) for _ in range(3)), many[3]]
    gray = np.full((H, W), 90)
    many.append((gray, gray, gray))
    other.append((gray, gray, gray))
    a, b = (pictures.hue_bins(rows(spark, x, ["r", "g", "b"])) for x in (many, other))
    got = {r["id"]: r["similarity"] for r in pictures.colour_similarity(a, b).collect()}
    for k, (p, q) in enumerate(zip(many, other, strict=True)):
        assert abs(got[k] - images.color_similarity(np.stack(p, -1), np.stack(q, -1))) < 1e-9
    parts = rows(spark, many, ["r", "g", "b"])
    tiles = pictures.hue_bins(parts.filter("x < 5")).union(pictures.hue_bins(parts.filter("x >= 5"))).groupBy("id", "bin").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, tiles.collect())) == sorted(map(tuple, a.collect()))


def masks(spark, many):
    return spark.createDataFrame([(k, int(x), int(y)) for k, m in enumerate(many) for y, x in zip(*np.nonzero(m), strict=True)], "id int, x int, y int")


def test_moments_and_shapes(spark):
    a, b = ([RNG.random((40, 50)) < p for p in (0.05, 0.3, 0.9)] for _ in range(2))
    far = np.zeros((4000, 4100), bool)
    far[3000:3040, 4000:4050] = a[1]
    a, b = [*a, far, a[0]], [*b, np.roll(far, 7), a[0]]
    p, q = masks(spark, a), masks(spark, b)
    hu = {r["id"]: np.array(r["hu"]) for r in pictures.log_hu(pictures.moments(p)).collect()}
    assert all(np.allclose(hu[k], images.log_hu(m), atol=1e-6) for k, m in enumerate(a)) and np.allclose(hu[3], hu[1], atol=1e-9)
    got = {r["id"]: r for r in pictures.shape_similarity(p, q).collect()}
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        assert abs(got[k]["iou"] - images.mask_iou(x, y)) < 1e-12 and abs(got[k]["similarity"] - images.shape_similarity(x, y)) < 1e-6
    tiles = pictures.moments(p.filter("x < 20")).union(pictures.moments(p.filter("x >= 20")))
    assert sorted(map(tuple, pictures.add_moments(tiles).collect())) == sorted(map(tuple, pictures.moments(p).collect()))
