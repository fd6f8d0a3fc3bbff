import numpy as np

from stepfold.llm import ann


def plain(rows, every, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in good:
        if q % every == 0:
            s = [(-float(good[q] @ v / np.sqrt((good[q] @ good[q]) * (v @ v))), i) for i, v in good.items() if i != q]
            out[q] = [(i, -x) for x, i in sorted((round(x, 12), i) for x, i in s)[:k]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_on_the_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = plain([(r["vec_id"], r["embedding"]) for r in df.collect()], 50, 5)
    got = result(ann.neighbours(df, block_rows=200))
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert sum(hits) >= 0.9 * 5 * len(want)
    exact = {q: dict(v) for q, v in plain([(r["vec_id"], r["embedding"]) for r in df.collect()], 50, 10**6).items()}
    assert all(abs(exact[q][i] - s) < 1e-9 for q in got for i, s in got[q])


def test_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 110)] + [(100, [1.0, 2.0, 3.0, 4.0])]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan"), 1.0, 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (205, []), (250, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "'x' AS v", "1 AS b")
    got = result(ann.neighbours(df))
    assert {q: [i for i, _ in v] for q, v in got.items()}.get(100) == [101, 102, 103, 104, 105]
    assert set(got) == {0, 100}


def test_blocks_of_queries_and_vectors_change_nothing(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(300)], "vec_id bigint, embedding array<double>")
    whole = result(ann.neighbours(df, every=7))
    assert result(ann.neighbours(df, every=7, block_rows=100, query_rows=10)) == whole
    assert set(whole) <= set(range(0, 300, 7)) and all(len(v) == 5 for v in whole.values())


def test_few_and_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], schema)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.neighbours(df).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.neighbours(spark.createDataFrame([], schema)).count() == 0


def test_beam_search_is_no_worse_than_greedy():
    x = np.random.default_rng(3).normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = ann.Codebooks.fit(x, books=4, words=16)

    def error(beam):
        codes, norms = books.encode(x, beam)
        back = books.flat[codes].sum(axis=1)
        assert np.allclose(np.linalg.norm(back, axis=1), norms, atol=1e-3)
        return ((x - back) ** 2).sum()

    assert error(8) <= error(1) + 1e-6
