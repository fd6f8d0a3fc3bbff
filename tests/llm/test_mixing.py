import hashlib
import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepfold.llm import mixing


def filled(sizes, weights, cap=3):
    """Water-filling by bisection on the level."""
    lo, hi = 0.0, sum(sizes) * 4.0 + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap * s, mid * w) for s, w in zip(sizes, weights, strict=True)) < sum(sizes) else (lo, mid)
    return [min(cap * s, hi * w) for s, w in zip(sizes, weights, strict=True)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=30))
def test_targets(sizes):
    weights = [i % 3 + 1 for i in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    assert all(abs(a - b) <= 1e-6 * max(1, sum(sizes)) for a, b in zip(got, filled(sizes, weights), strict=True))
    assert all(t <= 3 * s + 1e-6 for t, s in zip(got, sizes, strict=True)) and abs(sum(got) - sum(sizes)) <= 1e-6 * max(1, sum(sizes))


def plain(rows):
    """doc_id, size, source_size, target, taken by a sort of each whole source."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {n: sum(k for k, r in zip(size, rows, strict=True) if r[2] == n) for n in names}
    goal = dict(zip(names, filled([total[n] for n in names], [i % 3 + 1 for i in range(len(names))]), strict=True))

    def key(i):
        doc, text, _ = rows[i]
        u = (int(hashlib.md5(f"mix:{'' if doc is None else doc}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        text = text or ""
        return -math.log(u) / (0.1 + 0.9 * len(re.sub("[^A-Za-z ]+", "", text)) / max(len(text), 1))

    out = [None] * len(rows)
    for n in names:
        epochs = int((goal[n] + 1e-6) // total[n]) if total[n] else 0
        rest, upto = goal[n] - epochs * total[n], 0
        for i in sorted((i for i in range(len(rows)) if rows[i][2] == n), key=lambda i: (key(i), rows[i][0] is not None, rows[i][0] or 0, size[i])):
            before, upto = upto, upto + size[i]
            chosen = upto <= rest + 1e-6 or (rest > before and upto - rest < rest - before)
            out[i] = (rows[i][0], size[i], total[n], goal[n], size[i] * (epochs + bool(chosen and size[i] and rest > 1e-6)))
    return out


def check(df, **options):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    got = sorted((tuple(r) for r in mixing.mix(df, **options).select("doc_id", "size", "source_size", "target", "taken").collect()), key=lambda r: (str(r[0]), r[1], r[4]))
    want = sorted(plain(rows), key=lambda r: (str(r[0]), r[1], r[4]))
    assert [(a[0], a[1], a[2], a[4]) for a in got] == [(b[0], b[1], b[2], b[4]) for b in want]
    assert all(abs(a[3] - b[3]) < 1e-3 for a, b in zip(got, want, strict=True))


def test_odd_rows(odd):
    check(odd)


def test_small_table(small):
    check(small)
    check(small, buckets=3)


def test_many_sources(spark):
    rows = [(i, "w " * (i % 17 + 1), f"s{i % 9}" if i % 9 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    check(df)
    mix = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 9 for r in mix)


def test_empty_table(none):
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mixed_documents(small):
    times = {r["doc_id"]: r["times"] for r in mixing.mix(small).collect() if r["times"]}
    got = mixing.mixed_documents(small)
    assert got.columns == small.columns
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == times


def test_rows_that_share_an_id_are_told_apart(spark):
    # ids 1 to 3 stand in two sources and twice in one, with texts of one size; id null repeats one row
    rows = [(i, f"{w} " * (5 + i), s, n) for n, (w, s) in enumerate((("aa", "x"), ("bb", "x"), ("cc", "y"))) for i in (1, 2, 3)]
    rows += [(None, "again and again", "y", 9)] * 40 + [(i, "w " * 3, "z", 9) for i in range(10, 15)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, __n int").repartition(5)
    check(df)
    planned = Counter()
    for r in mixing.mix(df).collect():
        planned[r["source"], r["doc_id"], r["size"]] += r["times"]
    got = Counter((r["source"], r["doc_id"], len(r["text"].split())) for r in mixing.mixed_documents(df).collect())
    assert got == +planned
    sizes = {s: sum(len(t.split()) for _, t, k, _ in rows if k == s) for s in "xyz"}
    for s, goal in zip("xyz", mixing.targets(list(sizes.values()), [1, 2, 3]), strict=True):
        assert abs(sum(n * k[2] for k, n in got.items() if k[0] == s) - goal) <= 8


def test_ranges_are_even_for_every_quality(spark):
    from pyspark.sql import functions as F

    for quality in (0.1, 0.3, 1.0):
        keys = spark.range(200000).select((-F.log((F.col("id") + 0.5) / 200000) / quality).alias("key"))
        ranges = keys.groupBy(mixing.key_range(F.col("key"), 4096).alias("r")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).orderBy("r").collect()
        assert max(r["n"] for r in ranges) < 2 * 200000 / 4096
        assert all(x["b"] < y["a"] for x, y in zip(ranges, ranges[1:], strict=False))
