import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stepfold.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 90 + (90 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def result(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


def corpus(n, seed=0, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i * 3, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 40)))) for i in range(n)]


def items(n, seed=1, words=60):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{rng.randrange(words)}" for _ in range(rng.randint(1, 15)))) for i in range(n)]


@pytest.mark.parametrize(("postings", "query_rows"), [(1 << 20, 1000), (300, 7)])
def test_against_scoring_everything(spark, postings, query_rows):
    docs, asked = corpus(1500), items(25)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame(asked, "item_id bigint, text string")
    assert result(ranked.ranked(d, q, shard_postings=postings, query_rows=query_rows)) == plain(docs, asked)


def test_odd_rows(spark, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    asked = [(1, "the cat, le chat"), (1, "the cat, le chat"), (2, None), (3, ""), (None, "WORD end"), (5, "é中\U0001f600 A_b"), (6, "nowhere"), (7, "x" * 100000), (8, "the " * 3000 + " ".join(f"q{i}" for i in range(3000)))]
    q = spark.createDataFrame(asked, "item_id bigint, text string").selectExpr("*", "'x' AS term", "1 AS doc_id")
    assert result(ranked.ranked(odd, q)) == plain(docs, asked)
    assert result(ranked.ranked(none, q)) == []
    assert result(ranked.ranked(odd, q.limit(0))) == []
    assert result(ranked.ranked(odd.filter("text = '' OR text IS NULL"), q)) == []


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "same words here") for i in range(400, 0, -1)] + [(500, "other")]
    q = spark.createDataFrame([(0, "words")], "item_id bigint, text string")
    got = ranked.ranked(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), q)
    assert [r["doc_id"] for r in got.orderBy("rank").collect()] == list(range(1, 11))


def test_codes_of_numbers_come_back():
    x = np.concatenate((np.arange(300), np.array([2**7, 2**14 - 1, 2**14, 2**21, 2**35, 2**56])))
    data, at = ranked.packed(x)
    assert (ranked.unpacked(data) == x).all() and at[-1] == len(data)
    assert (ranked.unpacked(data[at[5] : at[9]]) == x[5:9]).all()


def test_blocks_below_the_threshold_stay_compressed():
    """One document has all terms; most blocks of the common term are never read."""
    shard, total = ranked.Shard(0), 0
    for i in range(20000):
        counts = Counter({b"common": 1, **({b"rare": 5, b"common": 9} if i < 3 else {f"u{i}".encode(): 30})})
        shard.add(i, counts)
        total += counts.total()
    rows = list(shard.rows(20000, total))
    m = np.frombuffer(rows[0][4], np.int64)
    held = {r[1]: r for r in rows[1:]}
    lists = ranked.Lists([held[b"common"][3], held[b"rare"][3]], [held[b"common"][4], held[b"rare"][4]], m)
    top = ranked.best(lists, [np.array([0, 1])], [np.array([1, 9000])], 3)
    assert [d for _, d in top[0]] == [0, 1, 2]
    assert lists.ready.sum() <= 3 and len(lists.ready) > 150
