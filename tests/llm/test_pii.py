import hashlib
import math
import random
import re

from stepfold.llm import pii


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain(text):
    text, out = text or "", []
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    for kind, (pattern, ok) in rules.items():
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if ok(m[0])]
    return ",".join(out)


def check(df):
    got = sorted(((r["doc_id"], r["base_sha256"]) for r in pii.digest_columns(pii.find(df)).collect()), key=str)
    want = sorted(((r["doc_id"], hashlib.sha256(plain(r["text"]).encode()).hexdigest()) for r in df.collect()), key=str)
    assert got == want


def test_odd_rows(odd):
    check(odd)


def test_small_table(small):
    check(small)


def test_empty_table(none):
    assert pii.find(none).count() == 0


def test_tricky_texts(spark):
    rng = random.Random(5)
    bits = ["a", "b.c", "@", ".", "..", "-", "_", "x@y.z", "1", "12", "255", "256", "007", " ", "  ", "+", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "0", "é", "\U0001f600", "\n", "1.2.3.4", "+1 555"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(600)]
    texts += ["a@b.c@d.e.f@g-h.i..j", "1.2.3.4.5.6.7.8.9", "a@" + "b." * 5000 + "c", "1" * 20000, "1 " * 20000, "x@y.z " * 3000, "+1" + "2" * 30000, "a." * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    check(df)


def test_disclosing_terms(spark):
    rows = [(i, f"the report by Quillfeather reached q.f@example.org on day {'abcdefghij'[i % 10] * 5} with the others") for i in range(6)]
    rows += [(10 + i, f"the report reached others on day {i} with nothing protected") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for most in (0, 100_000):
        terms = {(r["entity"], r["term"]) for r in pii.disclosing_terms(df, pii.looked_at(df), broadcast_terms=most).collect()}
        assert terms == {("email:q.f@example.org", "quillfeather")}
    found = {r["doc_id"]: r["spans"] for r in pii.digest_columns(pii.find(df)).collect()}
    assert found[0] == "email:35:50,term:14:26" and found[10] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[0] == "the report by  reached [email] on day aaaaa with the others" and clean[12] == rows[8][1]


def test_terms_of_whole_documents(spark):
    far = "common words without meaning " * 20
    rows = [(i, f"Dear Quillfeather, {far} q.f@example.org {far} yours, quillfeather {i}") for i in range(4)]
    rows += [(10, "a@x.com, b@x.com Wilson"), (11, "a@x.com, b@x.com Wilson 1"), (12, "a@x.com, b@x.com Wilson 2"), (13, "Quillfeather alone")]
    rows += [(20 + i, f"{far} {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    most = 100_000
    terms = {(r["entity"], r["term"]): (r["n_both"], r["n_entity"], r["n_term"]) for r in pii.disclosing_terms(df, pii.looked_at(df), broadcast_terms=most).collect()}
    assert terms[("email:q.f@example.org", "quillfeather")] == (4, 4, 5)
    assert ("email:a@x.com", "wilson") in terms and ("email:b@x.com", "wilson") in terms and not any(t in ("common", "example") for _, t in terms)
    found = {r["doc_id"]: r["terms"] for r in pii.find(df).collect()}
    text = rows[0][1]
    assert [text[x["start"] : x["end"]] for x in found[0] if text[x["start"] : x["end"]].lower() == "quillfeather"] == ["Quillfeather", "quillfeather"]
    assert found[13] == [] and [(x["start"], x["end"]) for x in found[10]] == [(17, 23)]
    assert "uillfeather" not in {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}[2]


def plain_terms(texts, support=3, threshold=0.9):
    """(entity, term) by counts over all pairs of different texts."""
    texts = {t or "" for t in texts}
    mail = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    held = {t: {f"email:{m[0].lower()}" for m in re.finditer(mail, t)} for t in texts}
    words = {t: {w.lower() for w in re.findall(r"[^\W\d_]{4,}", re.sub(mail, " ", t))} for t in texts}
    out = set()
    for e in set().union(*held.values()):
        with_e = [t for t in texts if e in held[t]]
        for w in set().union(*(words[t] for t in with_e)):
            both, n_w = sum(w in words[t] for t in with_e), sum(w in words[t] for t in texts)
            content = -math.log(len(with_e) / len(texts))
            if both >= support and content > 0 and math.log(both * len(texts) / (len(with_e) * n_w)) / content >= threshold:
                out.add((e, w))
    return out


def test_terms_against_brute_force(spark):
    rng = random.Random(8)
    names, filler = [f"name{c * 3}" for c in "abcdefgh"], [f"word{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = []
    for i in range(400):
        parts = rng.choices(filler, k=rng.randint(5, 30))
        for k in rng.sample(range(8), rng.randint(0, 2)):
            parts += [f"u{k}@mail.example.org"] * rng.choice((0, 1, 1, 1, 1, 1, 1, 1, 1, 2)) + [names[k]] * (rng.random() < 0.8)
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += [texts[3]] * 50 + [None, "", ""] + ["rare@copy.example.org onlyhere copied words"] * 200
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {(r["entity"], r["term"]) for r in pii.disclosing_terms(df, pii.looked_at(df)).collect()}
    # three copies and more are one text and disclose nothing
    assert got == plain_terms(texts) and any(t.startswith("name") for _, t in got) and not any(t == "onlyhere" for _, t in got)
    by = {}
    for e, t in got:
        by.setdefault(e, set()).add(t)
    for r in pii.find(df).collect():
        text = texts[r["doc_id"]] or ""
        want = {t for e, ts in by.items() if e[6:] in text for t in ts if t in text.split()}
        assert {text[x["start"] : x["end"]].lower() for x in r["terms"]} == want


def test_rewriting_overlaps(spark):
    df = spark.createDataFrame([("0123456789", [("ip", 1, 4), ("card", 3, 6), ("term", 7, 8)])], "text string, s array<struct<kind:string,start:int,end:int>>")
    assert df.select(pii.rewritten(df.text, df.s)).first()[0] == "0[ip]689"
