import base64
import hashlib
import zlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_exact_dedup import plain as plain_exact
from test_langid import plain_model, plain_predict
from test_mixing import plain as plain_mix
from test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def through_all_stages(spark, docs, tmp_path):
    """Each stage's rows against a brute-force version of it, on whole rows; returns the last stage's rows."""
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        full = [tuple(r) for r in docs.collect()]
        at = [docs.columns.index(c) for c in ("doc_id", "text", "source")]
        rows = [tuple(r[i] for i in at) for r in full]
        path = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        got = Counter(tuple(r) for r in docs.collect())
        if name == "language_id":
            lang = docs.columns.index("lang")
            taught = [(t, r[lang]) for (i, t, _), r in zip(rows, full, strict=True) if zlib.crc32(("" if i is None else str(i)).encode()) % 3 != 1]
            p, want, close = plain_model(taught), Counter(), set()
            for r, (_, t, _) in zip(full, rows, strict=True):
                lang, score = plain_predict(t, p)
                if abs(score - 0.4) < 2e-3:
                    close.add(r)
                elif lang != "und" and score >= 0.4:
                    want[r] += 1
            got = Counter({r: n for r, n in got.items() if r not in close})
        elif name == "exact_dedup":
            kept = {(r[0], r[4]) for r in plain_exact([(i, t) for i, t, _ in rows])  if r[3]}
            assert Counter((r[at[0]], hashlib.sha256("".join(c for c in r[at[1]] or "" if c not in " \t\n\x0b\x0c\r").encode()).hexdigest()) for r in got.elements()) == Counter(kept)
            want = got if set(got) <= set(full) else None
        elif name == "simhash_near_dedup":
            comp = plain_components([plain_fingerprint(t) for _, t, _ in rows])
            least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp)}
            want = Counter(full[i] for i in range(len(rows)) if rows[i][0] == least[comp[i]])
        elif name == "mixing":
            plan = Counter()
            for i, size, _, _, taken in plain_mix(rows):
                plan[i, size] += taken // size if size else 0
            out = Counter()
            for r in got.elements():
                out[r[at[0]], len([w for w in (r[at[1]] or "").replace("\x0b", " ").encode().split()])] += 1
            assert out == +plan and set(got) <= set(full)
            want = got
        else:
            own, want = encoding(), Counter()
            for i, t, _ in rows:
                ids = own.encode_ordinary(t or "")
                want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
        assert got == want, name
        assert name == "byte_bpe" or docs.columns == columns
    return got


def test_stages_on_odd_rows(spark, odd, tmp_path):
    # nulls in every column, very long texts, ties, repeated rows and extra columns; more rows so that languages can be learned
    rng = __import__("random").Random(3)
    en, fr = "the cat sat on a mat while dogs ran over old hills".split(), "le chien est dans la rue avec une vieille maison".split()
    more = [(100 + i, " ".join(rng.choices(en if i % 2 else fr, k=rng.randint(8, 40))), "en" if i % 2 else "fr", f"s{i % 3}" if i % 7 else None, i, None) for i in range(60)]
    more += [(None, "a null id and one text", "en", "s1", 0, None)] * 3 + [(300, "the same old hills and the cat", "en", "s2", 1, "a"), (301, "the same  old hills and the cat", "en", "s2", 2, "b")]
    docs = odd.unionAll(spark.createDataFrame(more, odd.schema)).withColumnRenamed("size", "key").withColumnRenamed("fp", "norm")
    assert len(through_all_stages(spark, docs, tmp_path)) > 20


def test_stages_against_brute_force(spark, tmp_path):
    through_all_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path)


def test_run_keeps_most_clean_documents(spark):
    got = corpus_pipeline.run(spark, SF)
    assert 50 < got.select("doc_id").distinct().count() <= 200
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
