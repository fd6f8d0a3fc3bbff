import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from stepfold.llm import entries, langid


def test_held_out_accuracy(spark):
    rows = entries.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    test = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in test) / len(test) >= 0.95


def test_odd_rows(odd, none):
    # a model of few rows would learn the very long ones only
    got = langid.predict(odd, langid.fit(odd.filter("length(text) < 1000"))).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert len(got) == odd.count()
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (2, 3, 4, 10))
    assert by[5]["lang_pred"] == "en" and by[9]["lang_pred"] == "fr"
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}


def test_mixtures_are_found():
    rng = np.random.default_rng(0)
    words = {k: ["".join(rng.choice(list(a), rng.integers(2, 7))) for _ in range(300)] for k, a in (("aa", "abcdefg"), ("bb", "hijklmn"), ("cc", "opqrstu"))}

    def text(k, n):
        return " ".join(rng.choice(words[k], n))

    totals = np.stack([langid.counts([text(k, 5000)])[0] for k in words])
    model = langid.Model(list(words), totals)
    pi = model.proportions(langid.counts([text("aa", 100) + " " + text("bb", 300), text("cc", 40)]))
    assert abs(pi[0][1] - 0.75) < 0.05 and pi[0][2] == 0 and (pi[1] > 0).sum() == 1


def test_counts_follow_a_plain_count():
    def plain(t):
        data, out = f" {t.lower()} ".encode(), np.zeros(langid.DIMS)
        for i in range(len(data) - 2):
            g = int.from_bytes(data[i : i + 3], "little")
            out[g * 2654435761 % (1 << 32) >> 20] += 1
        return out

    texts = ["", "A", "été Ünïcode", "the cat"]
    assert all((langid.counts([t])[0] == plain(t)).all() for t in texts)


def test_accepted_keeps_columns(odd):
    docs = odd.withColumn("extra", F.lit(1))
    got = langid.accepted(docs, langid.fit(odd.filter("length(text) < 1000")))
    ids = {r["doc_id"] for r in got.collect()}
    assert got.columns == docs.columns and {5, 7, 9} <= ids and not {2, 3, 4, 10} & ids


def test_more_than_three_languages():
    rng = np.random.default_rng(3)
    totals = rng.gamma(0.05, 100.0, (6, langid.DIMS))
    model = langid.Model(list("abcdef"), totals)
    share = np.array([0.37, 0.23, 0.20, 0.20, 0.0, 0.0])
    c = np.stack([rng.multinomial(4000, share @ model.p / (share @ model.p).sum()), rng.multinomial(4000, model.p[5] / model.p[5].sum())]).astype(np.float32)
    pi = model.proportions(c)
    assert (pi[0] > 0).sum() == 4 and abs(pi[0].max() - 0.37) < 0.03 and pi[0].argmax() == 0
    assert (pi[1] > 0).sum() == 1 and pi[1].argmax() == 5


def plain_counts(t):
    data, out = f" {t.lower()} ".encode(), {}
    for i in range(len(data) - 2):
        slot = int.from_bytes(data[i : i + 3], "little") * 2654435761 % (1 << 32) >> 20
        out[slot] = out.get(slot, 0) + 1
    return out


def plain_model(rows):
    """Each language's distribution from (text, lang) rows."""
    langs = sorted({k for _, k in rows if k is not None})
    total = {k: [0.5] * langid.DIMS for k in langs}
    for t, k in rows:
        for slot, n in plain_counts(t or "").items() if k is not None else ():
            total[k][slot] += n
    return {k: [x / sum(v) for x in v] for k, v in total.items()}


def plain_mixture(c, p, allowed, rounds):
    n, pi = max(sum(c.values()), 1), {k: 1 / len(allowed) if k in allowed else 0.0 for k in p}
    for _ in range(rounds):
        mixed = {s: sum(pi[k] * p[k][s] for k in p) for s in c}
        pi = {k: pi[k] * sum(m / mixed[s] * p[k][s] for s, m in c.items()) / n for k in p}
    return pi, sum(m * math.log(sum(pi[k] * p[k][s] for k in p)) for s, m in c.items())


def plain_predict(text, p, penalty=4.0, rounds=8):
    """Expectation-maximisation for every number of languages, without any early end."""
    if not p or not any(x.isalpha() for x in text or ""):
        return "und", 0.0
    c = plain_counts(text)
    full, _ = plain_mixture(c, p, set(p), rounds)
    order = sorted(p, key=lambda k: (-full[k], k))
    tries = []
    for k in range(1, len(p) + 1):
        pi, likely = plain_mixture(c, p, set(order[:k]), rounds if k > 1 else 1)
        tries.append((likely - k * penalty * math.log(max(sum(c.values()), 2)) / 2, -k, pi))
    pi = max(tries, key=lambda x: x[:2])[2]
    best = max(p, key=lambda k: pi[k])
    return best, pi[best] / sum(pi.values())


def test_mixtures_against_brute_force():
    rng = random.Random(5)
    alphabets = ("abcdefg", "efghijkl", "klmnopq", "opqrstu", "uvwxyz")
    words = {a: ["".join(rng.choices(a, k=rng.randint(2, 6))) for _ in range(80)] for a in alphabets}
    rows = [(" ".join(rng.choices(words[a], k=60)), a) for a in alphabets for _ in range(10)]
    p = plain_model(rows)
    model = langid.Model(list(p), np.stack([langid.counts([t for t, k in rows if k == a]).sum(axis=0) for a in p]))
    texts = [" ".join(" ".join(rng.choices(words[a], k=rng.randint(3, 80))) for a in rng.sample(alphabets, rng.randint(1, 5))) for _ in range(40)]
    langs, scores = model.predict(texts)
    sizes = set()
    for t, lang, score in zip(texts, langs, scores, strict=True):
        want, share = plain_predict(t, p)
        assert lang == want and abs(score - share) < 2e-3
        sizes.add(int((model.proportions(langid.counts([t]))[0] > 0).sum()))
    assert max(sizes) >= 4
