import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stepfold.llm import exact_dedup


def plain(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, t), k in zip(rows, norm, strict=True):
        group = [r for r, m in zip(rows, norm, strict=True) if m == k]
        keep = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        kept = i == keep[0] and len(t or "") == len(keep[1] or "")
        out.append((i, keep[0], len(group), kept, hashlib.sha256(k.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("capacity", [1 << 20, 1])
def test_odd_rows(odd, capacity):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = exact_dedup.assign(odd, capacity=capacity).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_small_table(small):
    assert sorted(map(tuple, exact_dedup.assign(small, capacity=7).collect()), key=str) == plain([(r["doc_id"], r["text"]) for r in small.collect()])


def test_empty_table(none):
    assert exact_dedup.assign(none).count() == 0 and exact_dedup.survivors(none).count() == 0


def test_survivors(odd):
    got = exact_dedup.survivors(odd)
    assert got.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in got.collect()]
    want = {(r[1], r[4]) for r in plain([(r["doc_id"], r["text"]) for r in odd.collect()])}
    assert len(rows) == len(want) and {i for i, _ in rows} == {i for i, _ in want}


def test_a_hot_text_of_many_copies(spark):
    # 2,500 copies with white space in different places, null ids among them, and texts of their own
    rows = [(i if i % 9 else None, "one hot text" + " " * (i % 3)) for i in range(2500)] + [(10_000 + i, f"text {i // 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    for options in ({}, {"capacity": 3, "owners": 5}):
        assert sorted(map(tuple, exact_dedup.assign(df, **options).collect()), key=str) == plain(rows)
        assert exact_dedup.survivors(df, **options).count() == 151


def test_ids_of_any_type(spark):
    rows = [("b", "x y"), ("a", "xy"), ("c", "x y"), (None, "x  y"), ("d", "z")]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.assign(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("b", None, 4, False), ("a", None, 4, False), ("c", None, 4, False), (None, None, 4, True), ("d", "d", 1, True)}


def test_the_index_is_laid_out_by_owner(small):
    rows = exact_dedup.light_rows(small)
    index = exact_dedup.build_index(small, rows.select("key"), owners=4)
    found = index.entries.select("owner", "bucket", "key", F.input_file_name().alias("file"))
    held = {}
    for r in found.collect():
        held.setdefault(r["file"], []).append((r["owner"], r["bucket"], r["key"] % (1 << 64)))
    ranges = sorted((min(x[1] for x in v), max(x[1] for x in v)) for v in held.values())
    assert all(len({x[0] for x in v}) == 1 for v in held.values()) and len(held) == 4
    # an owner's buckets, and so its keys, are a range of their own; the directory leads each key to its entry
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    keys = sorted((min(x[2] for x in v), max(x[2] for x in v)) for v in held.values())
    assert all(a[1] < b[0] for a, b in zip(keys, keys[1:], strict=False))
    assert index.located(index.entries.select("key", F.col("bucket").alias("b"), F.col("owner").alias("o"))).filter("b <> bucket OR o <> owner").isEmpty()
    assert found.select("bucket").distinct().count() > 50


def test_directory():
    rng = random.Random(4)
    for capacity in (1, 5, 50):
        slots = Counter(int(rng.random() ** 3 * 1024) for _ in range(2000))
        depth, entries = exact_dedup.build_directory(slots, capacity, max_depth=10)
        assert len(entries) == 1 << depth
        for k, (first, local) in enumerate(entries):
            assert first <= k << (10 - depth) < first + (1 << (10 - local)) and local <= depth
        for first, local in set(entries):
            held = sum(slots[s] for s in range(first, first + (1 << (10 - local))))
            assert held <= capacity or local == 10
            # no bucket was split without need: its parent would be too full
            parent = first >> (11 - local) << (11 - local) if local else 0
            assert local == 0 or sum(slots[s] for s in range(parent, parent + (1 << (11 - local)))) > capacity
