import hashlib
import random
import re
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stepfold.llm import token_alignment as ta

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Rows of the contract by whole texts, one after another."""
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    letters = ta._byte_letters()
    names = {i: t for t, i in own.get_vocab().items()}
    sp = sentencepiece.SentencePieceProcessor(model_file=B)

    def tokens(text):
        a = [(i, bytes(letters[c] for c in names[i])) for i in own.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in sp.encode(text):
            p = sp.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])

    def spans(side):
        at, out = 0, []
        for i, x in side:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    def run(docs):
        each = []
        for i, text in docs:
            a, b = map(spans, tokens(text) if text else ([], []))
            links, k = [], 0
            for x in a:
                while k < len(b) and b[k][2] <= x[1]:
                    k += 1
                j = k
                while j < len(b) and b[j][1] < x[2]:
                    links.append((x[0], b[j][0]))
                    j += 1
            cuts = sorted({x[2] for x in a} & {x[2] for x in b})
            groups, p, q = [], 0, 0
            for c in cuts:
                u = [x[0] for x in a[p:] if x[2] <= c] if len(a) < 2000 else None
                if u is None:  # long texts: step by step
                    u = []
                    while p + len(u) < len(a) and a[p + len(u)][2] <= c:
                        u.append(a[p + len(u)][0])
                v = []
                while q + len(v) < len(b) and b[q + len(v)][2] <= c:
                    v.append(b[q + len(v)][0])
                p, q = p + len(u), q + len(v)
                groups.append(",".join(map(str, u)) + "|" + ",".join(map(str, v)))
            each.append((i, len(a), len(b), groups, links))
        count = Counter(x for *_, links in each for x in links)
        top = Counter()
        for (_, y), n in count.items():
            top[y] = max(top[y], n)
        return sorted(((i, na, nb, len(g), len(l), sum(count[x] == top[x[1]] for x in l), sum(count[x] for x in l), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, na, nb, g, l in each), key=str)

    return run


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


ODD = [
    "a▁b and more", "<0x41> <s> </s> <|endoftext|> <unk>", "two  spaces   three\t\ttabs \n\n end ", " lead", "  leads", "trail ", "\nline\n", " ", "\t", "　wide　 space", "zero​width \x1c sep", "don't we'll I'M", "naïve café ﬁ ½ Ⅷ", "数字 中文 \U0001f600\U0001f468‍\U0001f469",
    "x" * 3000, "a b" * 700, "\x00 nul", "é combining", "word, word. Word! 12345 67", "‐‑‒ dashes —", "a▁b and more", "▁", "tab\tin side",
]


@pytest.mark.parametrize(("block_chars", "held"), [(1 << 24, 1 << 20), (200, 0)])
def test_odd_texts_against_whole_texts(spark, plain, block_chars, held):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, " lead"), (None, "no id"), (100, None), (101, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS block", "'x' AS piece").repartition(3)
    assert result(ta.align(df, A, B, block_chars=block_chars, held=held).documents) == plain(docs)


def test_small_table_against_whole_texts(spark, plain, small):
    docs = [(r["doc_id"], r["text"]) for r in small.collect()]
    found = ta.align(small, A, B)
    assert result(found.documents) == plain(docs)
    assert found.pairs.agg({"count": "sum"}).first()[0] == sum(r[4] for r in plain(docs))


def test_odd_rows_and_no_rows(spark, plain, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(ta.align(odd, A, B).documents) == plain(docs)
    assert ta.align(none, A, B).documents.count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert result(ta.align(empty, A, B).documents) == plain([(1, None), (2, "")])


def test_pieces_are_cut_at_all_places_and_no_other():
    rng = random.Random(3)
    for t in [*ODD, *("".join(rng.choices(" \n\tabÉß.,!'1日\u3000\x1c▁", k=rng.randint(1, 30))) for _ in range(3000))]:
        assert ta.pieces_of(t) == re.split(ta._CUT, " " + t)
    assert ta.pieces_of("one two.\nthree  four") == [" one", " two", ".\n", "three", "  four"]


def test_random_texts_by_pieces_and_whole(plain):
    """Both tokenisers part where texts are parted."""
    rng = random.Random(4)
    a, b = ta.byte_level(A), ta.sentence_pieces(B)
    words = ["the", "The", " ", "  ", "\n", "\n\n", ".", "...", ",", "don't", "'s", "'", "I'll", "12", "a1", "été", "Straße", "日本", "\t", "?!", "$$", "%", "é", "\u3000", "x_y", "-", "fi", "<s>", "<0x0A>"]
    for _ in range(3000):
        t = "".join(rng.choices(words, k=rng.randint(1, 12)))
        for side in (a, b):
            assert [i for x in side.encode(ta.pieces_of(t)) for i in x] == side.encode([" " + t])[0], t


def test_texts_part_at_spaces():
    assert ta.separable(ta.sentence_pieces(B))
    for t in (b"a b", b"a.", b"x\ny", b"\xc3\xa9,"):
        assert not ta.separable(ta.Tokenizer(list, [b" a", t]))
