"""License scans by patience alignment against templates.

A template's rarest words in the text give the places to look at; around each, a
window of the text is aligned with the template: words unique to both sides are
anchors, their longest increasing subsequence is kept, and the gaps between
anchors are aligned the same way, down to gaps without anchors, whose common
prefix and suffix still count.  Coverage is the share of the template's words that
are aligned; a template is reported where it is at least ``coverage``.

Templates are statements, notices and whole licenses.  Words in braces tell a
template from others and must be aligned themselves.  Of places that share at least
half of their aligned words (with all of those in braces) only the one is reported
whose aligned words exceed the template's missing ones by most.

Words are lower-case runs of letters and digits.  Every whole text is read; texts
that share too few words with a template to reach the coverage are passed over.

Defined results: null or empty text has no license; every place is reported, of equal
coverage the longer template's, then the first one first; repeated rows give repeated
rows; an empty table gives no rows; a very long text is read whole (its words are held);
other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

def _file(name: str, *needed: tuple[str, str]) -> str:
    """A whole license; each needed (words, marked words) tells it from a license of nearly the same text."""
    text = resources.files(__package__).joinpath("license_texts", f"{name}.txt").read_text().translate({ord("{"): " ", ord("}"): " "})
    for plain, marked in needed:
        assert plain in text
        text = text.replace(plain, marked)
    return text


def _gnu(work: str, kind: str, version: str) -> list[str]:
    """The notice of a GNU license, its first sentence, and the sentence of one version only."""
    terms = f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} {{Public}} License"
    first = f"{terms} as published by the Free Software Foundation, either version {version} of the License"
    rest = f"or (at your option) any later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind.translate(_PLAIN)} Public License for more details. You should have received a copy of the GNU {kind.translate(_PLAIN)} Public License along with this {work}"
    return [f"{first}, {rest}", first, f"{terms} version {version} as published by the Free Software Foundation"]


def _said(kind: str, version: str) -> list[str]:
    return [f"licensed under the {{gnu}} {kind} {{public}} license, version {version}", f"this work is licensed under the {{gnu}} {kind} {{public}} license, version {version}"]


_CC = {"by": "{attribution}", "sa": "{sharealike}", "nd": "{noderivatives}", "nc": "{noncommercial}"}
_PLAIN = {ord("{"): None, ord("}"): None}
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "3. {Neither} the name of the copyright holder nor the names of its contributors may be used to {endorse} or promote products derived from this software without specific prior written permission."
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

#: Statements, notices and whole licenses as their licenses word them; words in braces must be aligned.
TEMPLATES = {
    "MIT": ["released under the {mit} license", "licensed under the {mit} license", _GRANT, _GRANT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "Apache-2.0": ["licensed under the {apache} license, version {2}.0", "Licensed under the {Apache} License, Version {2}.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "{Apache} License Version {2}.0, January 2004", _file("Apache-2.0")],
    "GPL-3.0": [*_said("{general}", "{3}"), *_gnu("program", "{General}", "{3}"), "{GNU} {General} {Public} License Version {3}, 29 June 2007", _file("GPL-3.0", ("special requirements", "{special} {requirements}"))],
    "GPL-2.0": [*_said("{general}", "{2}"), *_gnu("program", "{General}", "{2}"), "{GNU} {General} {Public} License Version {2}, June 1991", _file("GPL-2.0")],
    "AGPL-3.0": [*_said("{affero} {general}", "{3}"), *_gnu("program", "{Affero} {General}", "{3}"), "{GNU} {Affero} {General} {Public} License Version {3}, 19 November 2007", "{Remote} {Network} {Interaction}; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software."],
    "LGPL": ["licensed under the {gnu} {lesser} {general} public license"],
    "LGPL-2.0": [*_said("{library} {general}", "{2}"), *_gnu("library", "{Library} {General}", "{2}"), "{GNU} {Library} {General} {Public} License Version {2}, June 1991", _file("LGPL-2.0")],
    "LGPL-2.1": [*_said("{lesser} {general}", "{2}.{1}"), *_gnu("library", "{Lesser} {General}", "{2}.{1}"), "{GNU} {Lesser} {General} {Public} License Version {2}.{1}, February 1999", _file("LGPL-2.1")],
    "LGPL-3.0": [*_said("{lesser} {general}", "{3}"), *_gnu("library", "{Lesser} {General}", "{3}"), "{GNU} {Lesser} {General} {Public} License Version {3}, 29 June 2007", _file("LGPL-3.0")],
    "BSD": ["released under the {bsd} license", "licensed under the {bsd} license", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", f"{_BSD} {_AS_IS}", f"{_BSD} {_NAMES} {_AS_IS}"],
    "ISC": [_ISC, _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2}.0", "licensed under the {mozilla} public license, version {2}.0", _file("MPL-2.0")],
    **{
        f"CC-{'-'.join(code).upper()}-4.0": [f"licensed under {{cc}} {' '.join(f'{{{c}}}' for c in code)} {{4}}.0", f"licensed under a {{creative}} {{commons}} {' '.join(_CC[c] for c in code)} {{4}}.0 international license"]
        for code in (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd"))
    },
    "CC0-1.0": ["released under {cc0} {1}.0", _file("CC0-1.0")],
    "proprietary": ["{all} {rights} {reserved}"],
}
_WORD = re.compile(r"[^\W_]+")
_PARTS = re.compile(r"[{}]|[^\W_]+")
_SHORT = 64


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def template_of(text: str) -> tuple[list[str], frozenset[int]]:
    """A template's words and the positions of those in braces."""
    words, needed, inside = [], [], False
    for part in _PARTS.findall(text.lower()):
        if part in "{}":
            inside = part == "{"
            continue
        if inside:
            needed.append(len(words))
        words.append(part)
    return words, frozenset(needed)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (i, j), sorted by i, in which j increases."""
    tails, ends, back = [], [], [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        tails[k : k + 1], ends[k : k + 1] = [j], [n]
        back[n] = ends[k - 1] if k else -1
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of two word lists by patience, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1 and in_a.get(b[j]) == 1}
        anchors = _increasing([(i, at[a[i]]) for i in range(a0, a1) if a[i] in at])
        out += anchors
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if k > i + 1 and m > j + 1]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, coverage: float = 0.8):
        self.coverage = coverage
        self.templates = [(name, *template_of(t)) for name, ts in templates.items() for t in ts]
        self.counts = [Counter(words) for _, words, _ in self.templates]
        self.owners = defaultdict(list)
        for k, counts in enumerate(self.counts):
            for w, n in counts.items():
                self.owners[w].append((k, n))
        self.vocabulary = frozenset(self.owners)

    def _windows(self, k: int, where: dict[str, list[int]]) -> Iterator[list[tuple[int, int]]]:
        """Of each place to look at, the windows of the text to align there, the best to be taken."""
        template = self.templates[k][1]
        # one of these is aligned wherever the coverage is reached: the rest would not do
        left = int((1 - self.coverage) * len(template) + 1e-9) + 1
        rare = set()
        for w, c in sorted(self.counts[k].items(), key=lambda x: (len(where.get(x[0], ())), x[0])):
            rare.add(w)
            left -= c
            if left <= 0:
                break
        reach, lo = len(template) + len(template) // 2 + 2, 0
        if len(template) <= _SHORT:
            at = sorted({i for w in rare for i in where.get(w, ())})
            while lo < len(at):
                hi = lo
                while hi + 1 < len(at) and at[hi + 1] - at[hi] <= 2 and at[hi + 1] - at[lo] <= reach:
                    hi += 1
                yield [(at[lo] - reach, at[hi] + reach)]
                lo = hi + 1
            return
        # where the template would start; the near window keeps the next copy's words out, the far one holds more insertions
        at = sorted({i - j for j, w in enumerate(template) if w in rare for i in where.get(w, ())})
        slack = len(template) // 4
        while lo < len(at):
            hi = lo
            while hi + 1 < len(at) and at[hi + 1] - at[lo] <= slack:
                hi += 1
            yield [(at[lo] - slack, at[hi] + len(template) + slack), (at[lo] - reach, at[hi] + len(template) + reach)]
            lo = hi + 1

    def _places(self, words: list[str]) -> Iterator[tuple]:
        """(template, pairs) of every place where a template reaches the coverage."""
        have = self.vocabulary.intersection(words)
        found = Counter()
        for w in have:
            for k, n in self.owners[w]:
                found[k] += n
        where = None
        for k, n in sorted(found.items()):
            _, template, needed = self.templates[k]
            least = self.coverage * len(template)
            # each template word that is missing costs at least one place
            if n < least or len(words) < least or any(template[j] not in have for j in needed):
                continue
            if where is None:
                where = defaultdict(list)
                for i, w in enumerate(words):
                    if w in have:
                        where[w].append(i)
            done = set()
            for windows in self._windows(k, where):
                for start, end in windows:
                    found = list(self._aligned(k, words, max(0, start), end, least))
                    fresh = [p for p in found if (p[0][0], p[-1][0], len(p)) not in done]
                    done.update((p[0][0], p[-1][0], len(p)) for p in fresh)
                    yield from ((k, p) for p in fresh)
                    if found:
                        break

    def _aligned(self, k: int, words: list[str], start: int, end: int, least: float) -> Iterator[list[tuple[int, int]]]:
        """The places in ``words[start:end]`` where template k reaches ``least`` aligned words, each besides the former."""
        _, template, needed = self.templates[k]
        todo = [(start, min(end, len(words)))]
        while todo:
            lo, hi = todo.pop()
            window = words[lo:hi]
            if len(window) < least or (len(template) > _SHORT and (Counter(window) & self.counts[k]).total() < least):
                continue
            pairs = [(lo + i, j) for i, j in align(window, template)]
            if len(pairs) >= least and needed.issubset(j for _, j in pairs):
                yield pairs
                # of a short template another place may lie in the same window
                todo += [(lo, pairs[0][0]), (pairs[-1][0] + 1, hi)] if len(template) <= _SHORT else []

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, end word) of every place, best first."""
        words = words_of(text)
        places = sorted(self._places(words), key=lambda x: (len(self.templates[x[0]][1]) - 2 * len(x[1]), x[1][0], x[0]))
        found: list[tuple] = []
        taken: set[int] = set()
        for k, pairs in places:
            name, template, needed = self.templates[k]
            if 2 * sum(i in taken for i, _ in pairs) >= len(pairs) and all(i in taken for i, j in pairs if j in needed):
                continue
            taken.update(i for i, _ in pairs)
            found.append((-len(pairs) / len(template), -len(template), pairs[0][0], name, pairs[-1][0] + 1))
        return [(name, -share, first, end) for share, _, first, name, end in sorted(found)]


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """doc_id, found: array of (license, coverage, first, end), best first."""
    rows = documents.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(templates, coverage)
        for b in batches:
            found = [[{"license": n, "coverage": c, "first": s, "end": e} for n, c, s, e in own.scan(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, found array<struct<license:string,coverage:double,first:bigint,end:bigint>>")
