import numpy as np
from pyspark.sql import functions as F

from stepfold.functions import boxes, camera, images, labels, scores
from stepfold.functions.json import tolerant_object


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_labels(spark):
    raw = [("The  Coffee_Table",), ('"a sofa"',), ("wall",), (None,), ("TV/monitor",), ("an-apple!",), (" / desk",)]
    assert values(spark, raw, "x string", labels.normalise(F.col("x"))) == ["coffee table", "sofa", "", "", "tv", "an apple", "desk"]
    more = {
        "a": "a", "the": "the", "the ": "the", '"the "': "", "a_lamp": "a lamp", "a  lamp": "lamp", "an the lamp": "the lamp", "'`\"Lamp\"`'": "lamp", "o'neil's rug": "oneils rug", "red . rug": "red  rug",
        "//": "", "/ /rug/mat": "rug", "!/rug": "rug", "rug / mat": "rug", "Éclair 2": "clair 2", "\tthe\trug\n": "rug", "' rug": "rug", "Walls": "", "the walls": "", "wall-": "", "12": "12", "--": "", "a/b": "a", "sofa_bed/x": "sofa bed",
    }
    assert values(spark, [(k,) for k in more], "x string", labels.normalise(F.col("x"))) == list(more.values())
    pairs = [("sofa", "bed"), ("chair", "table"), ("", "chair"), ("desk", "countertop"), ("lamp", "lamp")]
    assert values(spark, pairs, "a string, b string", labels.compatible(F.col("a"), F.col("b"))) == [True, False, True, True, True]
    assert values(spark, [(["a cup", "cup", "wall", None, "Mug"],)], "x array<string>", labels.distinct_labels(F.col("x"), 5)) == [["cup", "mug"]]


def test_ids(spark):
    i = F.col("i")
    rows = [("a__b__chain__step12",), ("x__step1__cycle__step2",), ("none",)]
    assert values(spark, rows, "i string", labels.case_of(i)) == ["a__b__chain", "x__step1__cycle", None]
    assert values(spark, rows, "i string", labels.subtype_of(i)) == ["chain", "cycle", None]
    assert values(spark, rows, "i string", labels.step_of(i)) == [12, 2, None]
    ids = spark.createDataFrame([("c", 1, 1), ("c", 2, 3)], "c string, s int, k int").select(labels.input_ids(F.col("c"), F.col("s"), F.col("k")))
    assert [r[0] for r in ids.collect()] == [["c:input:1"], ["c:generated:step1", "c:input:2", "c:input:3"]]


def test_boxes(spark):
    df = spark.range(1).select(boxes.box(F.lit(0.5), F.lit(1.5), F.lit(700.2), F.lit(9.0)).alias("b"), boxes.box(*map(F.lit, (5.0, 5.0, 5.0, 5.0))).alias("p"))
    one = df.select(boxes.safe_box(F.col("b"), 480, 640).alias("s"), boxes.safe_box(F.col("p"), 480, 640).alias("n"), boxes.iou(F.col("p"), F.col("p")).alias("z"), boxes.iou(F.col("b"), F.col("b")).alias("o")).first()
    assert tuple(one["s"]) == (0.0, 2.0, 639.0, 9.0) and one["n"] is None and one["z"] == 0.0 and one["o"] == 1.0


def test_scores_skip_what_is_not_needed(spark):
    rows = [(0.0, None, float("nan"), None), (1.0, 10.0, 0.0, "m"), (1.0, 0.0, 5.0, "deg")]
    assert values(spark, rows, "d double, e double, a double, u string", scores.action_score(F.col("d"), F.col("e"), F.col("a"), F.col("u"))) == [0.0, 1.0, 0.75]
    assert values(spark, [(None, None), (1.0, None), (0.5, 1.0)], "a double, b double", scores.available_composite([F.col("a"), F.col("b")], [1.0, 3.0])) == [None, 1.0, 0.875]


def test_tolerant_json(spark):
    rows = [('{"a": 1}',), ('Sure!\n```json\n{"a": 2,}\n```',), ('[{"a": 3}]',), ("nothing",), (None,), ('x {"a": [4,],} y',)]
    got = values(spark, rows, "t string", F.try_variant_get(tolerant_object(F.col("t")), "$.a", "string"))
    assert got == ["1", "2", "3", None, None, "[4]"]


def test_intrinsics(spark):
    k = [[100.0, 0.0, 50.0], [0.0, 100.0, 40.0], [0.0, 0.0, 1.0]]
    assert values(spark, [(k, [0.5, 0.5])], "k array<array<double>>, s array<double>", camera.scaled_intrinsics(F.col("k"), F.col("s"))) == [[[25.0, 0.0, 12.5], [0.0, 25.0, 10.0], [0.0, 0.0, 1.0]]]
    assert camera.digest([0.0, 1.0]) == camera.digest([-0.0, 1.0]) != camera.digest([1.0, 0.0])


def test_ground_alignment(spark):
    from pyspark.sql import functions as F

    from stepfold.operators import ground

    rng = np.random.default_rng(5)
    rows = []
    for scene in range(12):
        turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        where = rng.normal(size=(40, 3)) * [5, 3, 0.2] @ turn.T + rng.normal(size=3) * 1000
        for k in range(40):
            p = np.eye(4)
            p[:3, :3], p[:3, 3] = np.linalg.qr(rng.normal(size=(3, 3)))[0], where[k]
            p[:3, 1] = -turn[:, 2] + 0.1 * rng.normal(size=3)
            rows.append((f"s{scene}", k, p.ravel().tolist()))
    rows += [("one", 0, np.eye(4).ravel().tolist()), ("one", 1, None), (None, 0, np.eye(4).ravel().tolist()), ("none", 0, None)]
    df = spark.createDataFrame(rows, "scene_id string, frame int, pose array<double>").repartition(3)
    found = {r["scene_id"]: r for r in ground.alignments(df).collect()}
    got = {(r["scene_id"], r["frame"]): r["pose"] for r in ground.aligned(df).collect()}
    assert len(got) == len(rows) and got["one", 1] is None and got["none", 0] is None and set(found) == {f"s{k}" for k in range(12)} | {"one", None}
    for scene in (f"s{k}" for k in range(12)):
        poses = np.array([p for s, _, p in rows if s == scene]).reshape(-1, 4, 4)
        c = poses[:, :3, 3]
        u = np.array(found[scene]["rows"])
        assert np.allclose(u @ u.T, np.eye(3), atol=1e-12) and np.linalg.det(u) > 0
        values = np.linalg.eigvalsh(np.cov(c.T, bias=True))[::-1]
        assert np.allclose(found[scene]["spread"], values, rtol=1e-9)
        _, _, vt = np.linalg.svd(c - c.mean(axis=0))
        assert np.allclose(np.abs((u * vt).sum(axis=1)), 1, atol=1e-9)
        assert u[2] @ poses[:, :3, 1].mean(axis=0) < 0 and u[0][np.abs(u[0]).argmax()] > 0
        want = poses.copy()
        want[:, :3, :3], want[:, :3, 3] = u @ poses[:, :3, :3], (c - c.mean(axis=0)) @ u.T
        out = np.array([got[scene, k] for k in range(40)]).reshape(-1, 4, 4)
        assert np.allclose(out, want, atol=1e-8) and np.allclose(out[:, :3, 3].mean(axis=0), 0, atol=1e-9)
    # a diagonal matrix, equal values and zeros are axes as they stand
    for shape in ([3.0, 0.0, 0.0, 2.0, 0.0, 1.0], [1.0, 0.0, 0.0, 1.0, 0.0, 1.0], [0.0] * 6, [2.0, 1.0, 1.0, 2.0, 1.0, 2.0]):
        r = spark.range(1).select(ground.principal_axes([F.lit(x) for x in shape]).alias("x")).first()["x"]
        u = np.array([x["axis"] for x in r])
        m = np.array([[shape[0], shape[1], shape[2]], [shape[1], shape[3], shape[4]], [shape[2], shape[4], shape[5]]])
        assert np.allclose(u @ u.T, np.eye(3), atol=1e-12) and np.allclose(m @ u.T, u.T * [x["value"] for x in r], atol=1e-12)


def test_image_signals():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (40, 50, 3)).astype(np.uint8)
    g = images.gray(a)
    assert abs(images.ssim(g, g) - 1) < 1e-9 and images.ssim(g, 255 - g) < 0.1
    assert images.sharpness_ratio(g, g) == 1 and images.sharpness_ratio(g, images._blur(g)) < 0.2
    assert abs(images.color_similarity(a, a) - 1) < 1e-9
    m = np.zeros((40, 50), bool)
    m[5:20, 8:30] = True
    assert abs(images.shape_similarity(m, m) - 1) < 1e-9
    # moments do not change as a shape moves
    assert np.allclose(images.log_hu(m)[:2], images.log_hu(np.roll(m, 7, axis=1))[:2])
    assert (images.closed(m, 2) == m).all() and images.dilate(m).sum() == 17 * 24
    assert (images.half_size(np.arange(16).reshape(4, 4)) == [[2.5, 4.5], [10.5, 12.5]]).all()


def test_depths():
    d = np.full((48, 64), 2.0)
    d[:, 32:] = 30.0
    assert images.median_depth(d, (0, 0, 320, 240), image=(480, 640)) == 2.0
    assert images.median_depth(d, (400, 0, 600, 400), image=(480, 640)) is None
    x = np.r_[np.ones(99), 50.0, -1.0]
    assert images.clip_outliers(x)[99] == 0 and images.clip_outliers(x)[:99].sum() == 99
    k = np.array([[10.0, 0, 5], [0, 10, 5], [0, 0, 1]])
    mask = images.project(np.array([[0, 0, 1.0], [0, 0, -1], [9, 9, 1]]), k, np.eye(4), (10, 10))
    assert mask.sum() == 1 and mask[5, 5]


def test_keys_of_doubles_keep_order_and_come_back(spark):
    import struct

    from pyspark.sql import functions as F

    from stepfold.operators.order import double_key, key_double

    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 63, 4000).view(np.float64)
    x = [float(v) for v in x if v == v] + [2.0**e for e in range(-1074, 1024, 7)] + [float(np.nextafter(2.0**e, 0)) for e in range(-1021, 1024, 9)] + [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf")]
    x += [-v for v in x]
    rows = spark.createDataFrame([(v,) for v in x], "x double").withColumn("k", double_key(F.col("x"))).withColumn("back", key_double(F.col("k"))).collect()
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r["x"])))[0]
        assert r["k"] == (-bits if r["x"] < 0 else bits) and r["back"] == r["x"]
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(double_key(F.col("x")).alias("k")).collect()
    assert [r["k"] for r in odd] == [None, None]


def test_radix_quantiles_are_percentiles(spark):
    import random

    from pyspark.sql import functions as F

    from stepfold.operators import fold
    from stepfold.operators.order import radix_quantiles

    rng = random.Random(4)
    inf = float("inf")
    kinds = {"ties": lambda: float(rng.randint(0, 3)), "wide": lambda: rng.gauss(0, 1) ** 3, "one": lambda: 5.0, "ends": lambda: rng.choice([inf, -inf, 0.0, -0.0, 5e-324, -1e308, 1e308])}
    rows = [(g, kinds["ties"](), kinds["wide"](), kinds["one"]() if rng.random() < 0.9 else None, kinds["ends"]()) for g in ("a", "b", None) for _ in range(rng.randint(800, 6000))]
    rows += [("c", 1.0, float("nan"), None, None), ("d", 2.0, 1.0, 3.0, inf), ("d", 3.0, 2.0, 4.0, -inf)]
    df = spark.createDataFrame(rows, "g string, ties double, wide double, one double, ends double").repartition(4)
    same = lambda a, b: a is b or a is not None and b is not None and (a == b or a != a and b != b or abs(a - b) < 1e-9 * max(1, abs(b)))
    ps = [0.0, 0.5, 0.98, 1.0]
    for by in (["g"], None):
        got = {(r["g"] if by else None, r["column"], r["p"]): r["quantile"] for r in radix_quantiles(df, list(kinds), ps, by).collect()}
        for p in ps:
            want = {(r["g"] if by else None, r["column"], p): r["quantile"] for r in fold.quantiles(df, list(kinds), p, by, direct=True).collect()}
            assert {k for k in got if k[2] == p} == set(want)
            assert all(same(got[k], want[k]) for k in want), [(k, got[k], want[k]) for k in want if not same(got[k], want[k])]
    assert ("c", "one", 0.5) not in got
    empty = df.filter(F.lit(False))
    assert radix_quantiles(empty, ["wide"], ps).count() == 0
    for direct in (False, True):
        assert fold.summary(empty, ["wide"], direct=direct).first()["wide_median"] is None
    for by in (["g"], None):
        one, two = ({r["g"] if by else None: r.asDict() for r in fold.summary(df, list(kinds), by, direct).collect()} for direct in (False, True))
        assert one.keys() == two.keys() and all(same(one[g][c], two[g][c]) for g in two for c in two[g] if c != "g")


def test_radix_plan_has_no_window_and_no_sort_of_values(spark):
    from stepfold.operators.order import _narrowed, double_key
    from pyspark.sql import functions as F

    keys = spark.range(1000).select(F.lit("x").alias("column"), double_key(F.col("id").cast("double")).alias("key"))
    ranks = keys.groupBy("column").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).selectExpr("*", "0.5D AS p", "499.5D AS at", "499L AS rank", "499L AS wanted")
    plan = _narrowed(keys, ranks, ["column"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Percentile" not in plan


def test_radix_passes_are_few_and_move_no_key(spark, monkeypatch):
    """Numbers of all sizes and signs, in groups and without: three passes, four at most, each of which counts keys where they are read."""
    import random

    from pyspark.sql import functions as F

    from stepfold.operators import order

    rng = random.Random(9)
    rows = [(k % 3, rng.gauss(0, 1) * 10.0 ** rng.randint(-9, 9), rng.random()) for k in range(100_000)]
    df = spark.createDataFrame(rows, "g int, a double, b double").repartition(4)
    for by in ([], ["g"]):
        seen = []
        monkeypatch.setattr(order, "cut", lambda frame, keep=order.cut: seen.append(frame) or keep(frame))
        found = order.radix_quantiles(df, ["a", "b"], [0.05, 0.5], by).count()
        monkeypatch.undo()
        assert found == (12 if by else 4)
        assert len(seen) <= 4
        # a number's logarithm is worked out once, not wherever its key names it
        assert seen[0]._jdf.queryExecution().optimizedPlan().toString().lower().count("log2") <= 2
        for frame in seen[1:]:
            plan = frame._jdf.queryExecution().optimizedPlan().toString()
            assert "strategy=broadcast" in plan
    few = df.groupBy("g").agg(*(F.percentile(c, F.lit(p)).alias(f"{c}{p}") for c in ("a", "b") for p in (0.05, 0.5))).collect()
    want = {(r["g"], c, p): r[f"{c}{p}"] for r in few for c in ("a", "b") for p in (0.05, 0.5)}
    assert {(r["g"], r["column"], r["p"]): r["quantile"] for r in order.radix_quantiles(df, ["a", "b"], [0.05, 0.5], ["g"]).collect()} == want


def test_step_labels_read_each_place_once(spark):
    """Values that are named often are bound once: the size of the expression is what a row costs."""
    from pyspark.sql import functions as F

    from stepfold.functions import legacy

    docs = [
        (1, '{"target": {"qwen3vl_gt_object_labels": {"detector_prompt_labels": "Mug", "object_labels": ["b"]}}, "records": []}', "mug"),
        (2, '{"target": {"qwen3vl_gt_object_labels": {"object_labels": ["wall"]}}, "records": [{"step": 2, "object_labels": ["a"]}, {"step": 1, "object_labels": ["c", "The C", "d"]}]}', "c,d"),
        (3, '{"target": null, "records": [{"object_labels": ["e"]}, {"step": 1, "object_labels": ["f"]}]}', "e"),
        (4, '{"target": {"qwen3vl_gt_object_labels": {"object_labels": ["g"]}}}', "g"),
        (5, '{"records": [{"step": 3, "object_labels": ["h"]}]}', ""),
        (6, "{}", ""),
    ]
    doc = F.parse_json("doc")
    found = legacy.step_labels(F.try_variant_get(doc, "$.target", "variant"), F.try_variant_get(doc, "$.records", "array<variant>"), F.lit(0), F.lit(1))
    df = spark.createDataFrame(docs, "id int, doc string, want string").withColumn("got", F.array_join(found, ","))
    assert [r["got"] for r in df.orderBy("id").collect()] == [d[2] for d in docs]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 4
