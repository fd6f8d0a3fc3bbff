import random

from stepfold.llm import licenses


def longest_increasing(pairs):
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        best[i] = 1 + max((best[j] for j in range(i) if pairs[j][1] < pairs[i][1]), default=0)
    return max(best, default=0)


def test_increasing_subsequence_against_brute_force():
    rng = random.Random(1)
    for _ in range(100):
        js = rng.sample(range(50), rng.randint(0, 20))
        pairs = list(enumerate(js))
        got = licenses._increasing(pairs)
        assert len(got) == longest_increasing(pairs) and all(x[1] < y[1] and x[0] < y[0] for x, y in zip(got, got[1:], strict=False))


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 25))] for _ in range(2))
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        assert [i for i, _ in licenses.align(a, a)] == list(range(len(a)))


def test_statements():
    own = licenses.Scanner()
    filler = "the license of the version under which a work is the public general one " * 30
    assert own.scan(filler) == []
    assert own.scan(filler + "Released under the MIT License. " + filler)[0][:2] == ("MIT", 1.0)
    assert own.scan("Licensed under CC BY-NC 4.0.")[0][0] == "CC-BY-NC-4.0"
    assert own.scan("x\nLicensed under the\nApache   License, Version 2.0.\ny")[0] == ("Apache-2.0", 1.0, 1, 9)
    # a word changed and one inserted in a long notice
    notice = licenses.TEMPLATES["ISC"][0].replace("purpose", "aim").replace("hereby", "hereby freely")
    name, coverage, *_ = own.scan(filler + notice + " " + filler)[0]
    assert name == "ISC" and 0.9 < coverage < 1
    # twice the same statement: no word is unique in the text, but each place is looked at by itself
    assert own.scan("Released under the MIT License. " + filler + "Released under the MIT License.")[0][1] == 1.0


def names(text):
    return [x[0] for x in licenses.Scanner().scan(text)]


def test_every_place_is_reported():
    own, filler = licenses.Scanner(), "something else is said here " * 12
    assert own.scan("all rights reserved all rights reserved") == [("proprietary", 1.0, 0, 3), ("proprietary", 1.0, 3, 6)]
    found = own.scan(f"Released under the MIT License. {filler} Licensed under CC BY 4.0. {filler} Released under the MIT License.")
    assert sorted((x[0], x[1]) for x in found) == [("CC-BY-4.0", 1.0), ("MIT", 1.0), ("MIT", 1.0)]
    notice = licenses.TEMPLATES["ISC"][1]
    assert [x[0] for x in own.scan(f"{notice} {filler} {notice}")] == ["ISC", "ISC"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_statements_against_brute_force():
    """Words of statements in random texts: what is reported is there by the longest common subsequence of its
    place, and no statement that stands whole in the text is left out."""
    rng = random.Random(7)
    short = {n: [t for t in ts if len(licenses.template_of(t)[0]) <= 14] for n, ts in licenses.TEMPLATES.items()}
    short = {n: ts for n, ts in short.items() if ts}
    own = licenses.Scanner(short)
    pool = sorted({w for ts in short.values() for t in ts for w in licenses.template_of(t)[0]}) + ["x", "y", "z"]
    for _ in range(150):
        whole = [rng.choice([(n, t) for n, ts in short.items() for t in ts]) for _ in range(rng.randint(0, 3))]
        parts = []
        for n, t in whole:
            parts += rng.choices(pool, k=rng.randint(0, 20)) + ["q"] * 30 + licenses.template_of(t)[0] + ["q"] * 30
        words = parts + rng.choices(pool, k=10)
        found = own.scan(" ".join(words))
        for name, coverage, first, end in found:
            best = max(lcs(words[first:end], licenses.template_of(t)[0]) / len(licenses.template_of(t)[0]) for t in short[name])
            assert 0.8 <= coverage <= best + 1e-9
        at = {(first, end) for _, _, first, end in found}
        for _, t in whole:
            k = licenses.template_of(t)[0]
            places = [i for i in range(len(words)) if words[i : i + len(k)] == k]
            assert all(any(s <= i and e >= i + len(k) for s, e in at) for i in places)


def test_notices_of_near_licenses_are_told_apart():
    head = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    for work, kind, version, name in (("program", "General Public", "2", "GPL-2.0"), ("program", "General Public", "3", "GPL-3.0"), ("library", "Lesser General Public", "2.1", "LGPL-2.1"), ("library", "Library General Public", "2", "LGPL-2.0"), ("program", "Affero General Public", "3", "AGPL-3.0")):
        assert names(f"word {head.format(work, kind, version)} word") == [name]


def test_whole_licenses():
    for name, text in licenses.TEMPLATES.items():
        assert names("before " + text[-1].replace("{", " ").replace("}", " ") + " after") == [name]
    apache = licenses.TEMPLATES["Apache-2.0"][-1]
    assert names(apache[: apache.index("APPENDIX")]) == ["Apache-2.0"]
    gpl = licenses.TEMPLATES["GPL-3.0"][-1].replace("{", " ").replace("}", " ")
    assert licenses.Scanner().scan("before " + gpl * 2)[0][:3] == ("GPL-3.0", 1.0, 1)
    # without the words that the AGPL lacks the body is not the GPL's, only the notice at its end is
    found = licenses.Scanner().scan(gpl[gpl.index("Preamble") :].replace("requirements", "terms"))
    assert [end - first < 200 for name, _, first, end in found if name == "GPL-3.0"] == [True]


def test_short_statements_need_their_own_words():
    assert names("Released under the MIT License.") == ["MIT"]
    assert names("Licensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert names("Licensed under the Apache License, Version 1.1.") == []
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert names("Licensed under CC BY 4.0.") == ["CC-BY-4.0"] and names("Licensed under CC BY-NC-SA 4.0.") == ["CC-BY-NC-SA-4.0"]
    assert sorted(names("Licensed under the MIT License or the Apache License, Version 2.0.")) == ["Apache-2.0", "MIT"]


def test_tables(spark, odd, none, small):
    assert licenses.scan(none).count() == 0
    assert all(r["found"] == [] for r in licenses.scan(odd).collect())
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    for r in licenses.scan(small).collect():
        said = texts[r["doc_id"]] or ""
        for statement, name in (("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0")):
            assert (statement not in said) or name in {x["license"] for x in r["found"]}
