import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from stepfold.llm import substring


def plain(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(df, **options):
    rows = df.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], *x) for r, x in zip(rows, plain([r["text"] for r in rows], options.get("window", 35)), strict=True)), key=str)
    got = sorted(map(tuple, substring.digests(df, **options).collect()), key=str)
    assert got == want
    return got


def made(spark, seed=0, n=60):
    rng = np.random.default_rng(seed)
    passage = [" ".join(f"p{k}w{i}" for i in range(60)) for k in range(3)]
    rows = []
    for i in range(n):
        parts = [" ".join(f"v{x}" for x in rng.integers(0, 40, rng.integers(0, 90)))]
        if i % 3 == 0:
            parts += [passage[i % 2], " ".join(f"v{x}" for x in rng.integers(0, 40, 20))]
        if i % 5 == 0:
            parts += [passage[2][: 150 + i * 3], "a b " * (i % 30)]
        rows.append((i, " ".join(parts)))
    rows += [(n, rows[0][1]), (n + 1, rows[3][1] + " tail"), (n + 2, "same " * 200), (n + 2, "same " * 200)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)


def test_odd_rows(odd):
    check(odd)


def test_planted_passages(spark):
    assert sum(r[2] for r in check(made(spark))) > 1000


def test_hot_keys_go_by_windows(spark):
    check(made(spark, 1), cap=3, shard_words=500)


def test_many_continuations_take_one_round(spark, monkeypatch):
    """A passage that goes on in more ways than a key may have segments: one pass over windows, whatever the number."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"h{i} i{i} {passage} " + " ".join(f"c{i}x{k}" for k in range(30))) for i in range(60)]
    calls = []
    whole = substring._by_windows
    monkeypatch.setattr(substring, "_by_windows", lambda *a: calls.append(a) or whole(*a))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert all(r[2] == 60 for r in check(df, cap=20))
    assert len(calls) == 1


def test_short_windows(spark):
    check(made(spark, 2), window=12, gram=5)


def test_small_table(small):
    check(small)


def test_empty_table(none):
    assert substring.digests(none).count() == 0


def test_removed_text(spark):
    df = spark.createDataFrame([(1, "x " + "q w e r t y " * 10), (2, "z " + "q w e r t y " * 10)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in substring.remove_repeated(df).collect()} == {1: "x", 2: "z"}


@pytest.mark.parametrize("depth", [1, 3, 7, 35])
def test_matching_statistics(depth):
    rng = np.random.default_rng(depth)
    seqs = [rng.integers(1, 4, rng.integers(1, 60)) for _ in range(12)]
    text = np.concatenate([np.append(s, 0) for s in seqs])
    weight = np.repeat(rng.integers(1, 3, 12), [len(s) + 1 for s in seqs])
    ends = np.flatnonzero(text) + 1
    got = substring.FMIndex(text, weight, depth).statistics(text, ends, depth)
    for e, g in zip(ends.tolist(), got.tolist(), strict=True):
        def places(k, e=e):
            pat = text[e - k : e]
            return 0 if (pat == 0).any() else sum(int(weight[i]) for i in range(len(text) - k + 1) if (text[i : i + k] == pat).all())
        k = 0
        while k < min(depth, e) and places(k + 1) >= 2:
            k += 1
        assert g == k


def test_words_hash_alike_across_blocks():
    text = "alpha  beta\tgamma é中 " * 3
    h = substring.word_hashes(text)
    assert len(set(h.tolist())) == 4 and (h[:4] == h[4:8]).all()
