import numpy as np
import pytest

from stepfold.llm import embedding_dedup as ed


def plain(rows, threshold=0.9):
    """By all pairs: (n_links, component) of each row by position."""
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i].add(j)
    out = []
    for i, (own, _) in enumerate(rows):
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((own, len(links[i]), min(ids, default=None)))
    return sorted(out, key=str)


def result(df):
    got = df.collect()
    assert all(r["kept"] == (None if r["vec_id"] is None or r["component_id"] is None else r["vec_id"] == r["component_id"]) for r in got)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str)


def clouds(n=240, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        centre = np.random.default_rng(1000 + i % 20).normal(size=dim)
        rows.append((i, (centre + rng.normal(scale=0.25, size=dim)).tolist()))
    return rows


@pytest.mark.parametrize("cap", [4096, 10])
def test_clouds_against_all_pairs(spark, cap):
    rows = clouds()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    assert result(ed.near_duplicates(df, miss=1e-7, cap=cap)) == plain(rows)


def test_copies_and_odd_vectors(spark):
    rows = clouds(60) + [(100 + i, [1.0] * 12) for i in range(40)] + [(100, [1.0] * 12), (7, [2.0] * 12), (None, [1.0] * 12)]
    rows += [(200, None), (201, [0.0] * 12), (202, [1.0, None] + [0.0] * 10), (203, [float("nan")] * 12), (204, [float("inf")] + [1.0] * 11), (None, None), (None, [3.0, 4.0]), (205, []), (206, [1.0, 2.0]), (207, [1.0, 2.0]), (208, [1e300] * 12), (209, [1e-300] * 12)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' AS v", "1 AS node", "2 AS code")
    assert result(ed.near_duplicates(df, miss=1e-7)) == plain(rows)


def test_no_rows_one_row_and_only_unusable(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert result(ed.near_duplicates(spark.createDataFrame([], schema))) == []
    assert result(ed.near_duplicates(spark.createDataFrame([(5, [1.0, 2.0])], schema))) == [(5, 0, 5)]
    assert result(ed.near_duplicates(spark.createDataFrame([(5, None), (5, None)], schema))) == [(5, 0, 5)] * 2


def test_a_pair_counts_in_its_first_table_only():
    x = np.array([[1.0, 0.0], [1.0, 0.1], [0.0, 1.0]])
    code = np.array([[1, 1], [1, 1], [0, 1]])
    own, copies = np.zeros(3, int), np.array([1, 3, 1])
    first = ed.bucket_links(x[:2], own[:2], copies[:2], code[:2], 0, 0, 0, 0.9)
    again = ed.bucket_links(x, own, copies, code, 1, 0, 0, 0.9)
    assert first[0].tolist() == [3, 1] and again[0].tolist() == [0, 0, 0]


def test_tables_for_a_miss_chance():
    for n in (10, 10**6, 10**9):
        bits, tables = ed.plan(n, 0.9, 0.001)
        same = 1 - np.arccos(0.9) / np.pi
        assert (1 - same**bits) ** tables <= 0.001 < (1 - same**bits) ** (tables - 1)
    assert ed.plan(100, 1.0) == (8, 1)


def test_whole_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert result(ed.near_duplicates(df)) == plain([(r["vec_id"], r["embedding"]) for r in df.collect()])
