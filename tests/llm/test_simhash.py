import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from stepfold.llm import simhash
from stepfold.llm.components import stars


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps, budget=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(fps)
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    want = sorted(((rows[i][0], fps[i], least[comp[i]]) for i in range(len(rows))), key=str)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == want


def test_odd_rows(odd):
    check(odd)


def test_small_table(small):
    check(small)


def test_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97} x{i % 89}" for i in range(5000))
    blocks = simhash.word_blocks
    monkeypatch.setattr(simhash, "word_blocks", lambda d: blocks(d, 1000))
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def random_near(rng, n, centres):
    base = rng.integers(0, 1 << 63, centres, dtype=np.uint64)
    out = base[rng.integers(0, centres, n)]
    for _ in range(5):
        out = out ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(out)


def test_trie_matches_all_pairs():
    rng = np.random.default_rng(1)
    for n, centres in ((3, 1), (400, 4), (900, 200)):
        v = random_near(rng, n, centres)
        i, j = simhash.trie_links(np.zeros(len(v), np.int64), v, 4, chunk=512)
        root = np.arange(len(v))
        root[i] = j
        assert root.tolist() == plain_components([int(x) for x in v])


def test_links_when_groups_are_dealt_again(spark):
    v = random_near(np.random.default_rng(2), 600, 5)
    nodes = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp bigint")
    want = plain_components([int(x) for x in v])
    for cap in (50_000, 20):
        got = {r["u"]: r["v"] for r in stars(simhash.links(nodes, 4, cap=cap)).collect()}
        signed = v.view(np.int64).tolist()
        classes = {}
        for x, c in zip(signed, want, strict=True):
            classes.setdefault(c, set()).add(got.get(x, x))
        assert all(len(s) == 1 for s in classes.values())
        assert len({next(iter(s)) for s in classes.values()}) == len(classes)


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = stars(edges).collect()
    assert {r["v"] for r in got} == {0} and len(got) == 200
