import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from stepfold.llm import bpe

FILES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


def reference(file):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(file), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "\n\n  \t x", "Hello world's  end", "é中\U0001f600 \x1c\x85　a", "<|endoftext|> <unk> ▁", "x" * 5000, "1234567 ١٢٣", "á Ŋǅ ª º", "don't DON'T", "\x00\x01\x7f", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 ﷺ"]


@pytest.mark.parametrize("file", FILES)
def test_codec_matches_tiktoken(file):
    own, other = bpe.codec(public_tokenizers.path(file), public_tokenizers.PATTERN), reference(file)
    rng = random.Random(7)
    chars = [chr(c) for c in (*range(32, 127), *range(160, 600), 0x4E2D, 0x1F600, 9, 10, 13, 0x3000, 0x2028)]
    texts = TEXTS + ["".join(rng.choices(chars, k=rng.randint(0, 80))) for _ in range(800)]
    for t in texts:
        ids = own.encode(t)
        assert ids == other.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_runs_are_joined():
    own = bpe.codec(public_tokenizers.path(FILES[0]), public_tokenizers.PATTERN)
    text = "some words and more words " * 50
    ids = own.encode(text)
    assert [i for run in own.runs(text, 7) for i in run] == ids
    n, a, b = own.digest(text)
    assert n == len(ids) and a == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and b == hashlib.sha256(text.encode()).hexdigest()


def test_tables(spark, odd, none, small):
    path, other = public_tokenizers.path(FILES[0]), reference(FILES[0])
    for df in (odd, small):
        want = []
        for r in df.collect():
            ids = other.encode_ordinary(r["text"] or "")
            want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
        assert sorted(map(tuple, bpe.digests(df, path, public_tokenizers.PATTERN).collect()), key=str) == sorted(want, key=str)
    assert bpe.digests(none, path, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(small, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["data"]).decode() for r in back.collect()} == {r["doc_id"]: r["text"] for r in small.collect()}


def test_digests_of_many_texts_are_those_of_each(monkeypatch):
    rng = random.Random(9)
    own = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ["".join(rng.choices("ab cé中\U0001f600 1\n.", k=rng.choice((0, 1, 30, 300, 3000)))) for _ in range(60)] + ["x" * 5000, "", "word " * 900]
    fresh = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = [fresh.digest(t) for t in texts]
    monkeypatch.setattr(bpe.Codec, "MOST", 50)  # pre-tokens are forgotten and come back
    assert list(own.digests(texts, size=1000, together=4000)) == want
    assert [own.digest(t, 100) for t in texts] == want
    for t, (n, ids, back) in zip(texts, want, strict=True):
        found = own.encode(t)
        assert n == len(found) and hashlib.sha256(",".join(map(str, found)).encode()).hexdigest() == ids
        assert hashlib.sha256(t.encode()).hexdigest() == back and own.decode(found) == t.encode()
