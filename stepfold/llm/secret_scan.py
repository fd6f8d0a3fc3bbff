"""Secret scans: fixed patterns, and strings that a primed compressor cannot explain.

The patterns find assignments, access keys and long hex strings.  Beside them, each
candidate string of the text in a sensitive context (a word such as key, token or
auth within ``reach`` code points of it, on either side or inside) is measured by its
marginal compressed size: the surrounding code is compressed with zstandard, primed
with a dictionary of the corpus's identifiers, once without the candidate and once
with it.  If the added bytes are at least ``novelty`` of its length, neither the
surroundings nor the corpus explain it and it is reported.  Where the whole is
explained, what its first context word begins and what follows its last ``=`` are
tried.  A reported candidate goes on to the adjacent lines that are candidates
themselves, and lines of one length to the shorter one that ends them.

The identifier dictionary holds the most frequent identifiers of all texts, up to
``dictionary_bytes`` (its size is the feature; counts cover every row).

Spans are code points, end exclusive.  Defined results: null text counts as empty;
repeated rows give repeated rows; an empty table gives no rows; a very long text takes
time in proportion to its length; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(r"(?ai:key|secret|token|passw|credential|auth|private|bearer|signature)")
_LEAST = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_PAD = "\x20\t\"'>"
_BREAK = re.compile(r"""[\x20\t"',;\\]*+\r?\n[\x20\t"'>]*+""")
_CLOSE = re.compile(r"""[\x20\t"',;\\]*+\r?(?:\n|\Z)""")
_REST = re.compile(rf"""{_BREAK.pattern}([A-Za-z0-9+/_=-]{{1,15}}+)(?={_CLOSE.pattern})""")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


class Novelty:
    """Marginal compressed size against surroundings and a corpus dictionary."""

    def __init__(self, dictionary: bytes, novelty: float = 0.7, around: int = 120, reach: int = 48):
        self.novelty, self.around, self.reach = novelty, around, reach
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None
        if primed is not None:
            primed.precompute_compress(level=3)
        options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.size = lambda data, c=zstandard.ZstdCompressor(level=3, dict_data=primed, **options): len(c.compress(data))

    def ratio(self, text: str, start: int, end: int) -> float:
        before = text[max(0, start - self.around) : start]
        after = text[end : end + self.around]
        known = (before + after).encode()
        return (self.size(known + text[start:end].encode()) - self.size(known)) / (end - start)

    def _novel(self, text: str, start: int, end: int, inside: int | None) -> int | None:
        """Where the novel part of a candidate starts: the whole, what its first context word begins, or what follows its last '='."""
        tries = [start, inside, text.rfind("=", start, start + len(text[start:end].rstrip("="))) + 1]
        for at in tries:
            if at is None or at < start or end - at < _LEAST:
                continue
            word = text[at:end]
            if _DIGIT.search(word) and _LETTER.search(word) and self.ratio(text, at, end) >= self.novelty:
                return at
        return None

    def spans(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Novel candidates, and the lines that go on with a reported one, that overlap no span already taken."""
        context = [m.span() for m in _CONTEXT.finditer(text)]
        if not context and not taken:
            return []
        first, last = [s for s, _ in context], [e for _, e in context]
        starts = sorted((s, e) for s, e, _ in taken)
        runs = [m.span() for m in _CANDIDATE.finditer(text)]
        begins: list[int | None] = [None] * len(runs)  # where the reported part begins
        free = [True] * len(runs)
        k, reached = 0, -1
        for n, (start, end) in enumerate(runs):
            while k < len(starts) and starts[k][0] < end:
                reached = max(reached, starts[k][1])
                k += 1
            if reached > start:
                begins[n], free[n] = start, False
                continue
            c = bisect_left(last, start - self.reach)
            if c < len(context) and first[c] <= end + self.reach:
                c = bisect_left(first, start, c)
                begins[n] = self._novel(text, start, end, first[c] if c < len(first) and first[c] < end else None)
        # a secret over several lines: lines of nothing but one candidate, next to a reported one
        for order, step in ((range(len(runs)), -1), (range(len(runs) - 1, -1, -1), 1)):
            for n in order:
                m = n + step
                if begins[n] is None and 0 <= m < len(runs) and begins[m] is not None and _goes_on(text, runs[n], runs[m]):
                    begins[n] = runs[n][0]
        out = [(b, e, "novel") for b, (_, e), f in zip(begins, runs, free, strict=True) if f and b is not None]
        # lines of one length may end in a shorter one
        for n in range(1, len(runs)):
            (a0, a1), (b0, b1) = runs[n - 1 : n + 1]
            if begins[n - 1] is not None and begins[n] is not None and a1 - a0 == b1 - b0 and _broken(text, a1, b0):
                rest = _REST.match(text, b1)
                if rest and any(map(str.isalnum, rest[1])):
                    out.append((rest.start(1), rest.end(1), "novel"))
        clear = []
        k, reached = 0, -1
        for s, e, kind in sorted(out):
            while k < len(starts) and starts[k][0] < e:
                reached = max(reached, starts[k][1])
                k += 1
            if reached <= s:
                clear.append((s, e, kind))
        return clear


def _broken(text: str, end: int, start: int) -> bool:
    """Nothing but one line break, indentation and quotes lies between."""
    m = _BREAK.match(text, end, start)
    return m is not None and m.end() == start


def _goes_on(text: str, one: tuple[int, int], reported: tuple[int, int]) -> bool:
    """The candidate is alone in its line, next to a reported one, and looks like a part of a secret."""
    (start, end), (low, high) = one, reported
    if not (_broken(text, high, start) if high <= start else _broken(text, end, low)):
        return False
    before = start
    while before > 0 and text[before - 1] in _PAD:
        before -= 1
    if not (before == 0 or text[before - 1] == "\n") or not _CLOSE.match(text, end):
        return False
    word = text[start:end]
    return bool(_DIGIT.search(word) and _LETTER.search(word)) or (end - start == high - low and any(map(str.isalnum, word)))


def _frequent(words: DataFrame, most: int, steps: int = 8) -> DataFrame:
    """(word, count) of the words at least as frequent as the ``most``-th one, and few others.

    A histogram over the logarithms of the counts (64 * ``steps`` rows at most) tells
    where to stop, so no task sends the driver a list of its own most frequent words.
    """
    counts = cut(words.groupBy("word").count().filter("count > 1"))
    level = F.floor(F.log2(F.col("count")) * steps)
    least, above = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        least, above = r["level"], above + r["n"]
        if above >= most:
            break
    return counts.filter(level >= least)


def identifier_dictionary(documents: DataFrame, text_col: str = "text", dictionary_bytes: int = 1 << 15) -> bytes:
    """The most frequent identifiers of the corpus, the most frequent last (nearest, for zstandard)."""
    words = documents.select(F.explode(F.array_distinct(F.regexp_extract_all(text_or_empty(text_col), F.lit(r"[A-Za-z_][A-Za-z0-9_]{5,63}"), F.lit(0)))).alias("word"))
    most = dictionary_bytes // 7
    top = _frequent(words, most).orderBy(F.desc("count"), "word").limit(most).collect()
    out, size = [], 0
    for r in top:
        size += len(r["word"]) + 1
        if size > dictionary_bytes:
            break
        out.append(r["word"])
    return "\n".join(reversed(out)).encode()


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, found: array of (kind, start, end) by start, then kind as listed, novel last."""
    dictionary = identifier_dictionary(documents, text_col)
    rows = documents.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    order = {k: i for i, k in enumerate((*KINDS, "novel"))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary, **options)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = []
            for t in b.column(1):
                text = t.as_py()
                base = base_spans(text)
                both = sorted(base + novelty.spans(text, base), key=lambda x: (x[0], order[x[2]]))
                found.append([{"kind": k, "start": s, "end": e} for s, e, k in both])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, found array<struct<kind:string,start:bigint,end:bigint>>")


def masked(text: str, found: list[dict], with_: str = "[secret]") -> str:
    """The text with each found span replaced, overlapping ones together."""
    out, at = [], 0
    for x in sorted(found, key=lambda x: (x["start"], -x["end"])):
        if x["start"] >= at:
            out += [text[at : x["start"]], with_]
        at = max(at, x["end"])
    return "".join(out) + text[at:]


def digest_columns(scanned: DataFrame) -> DataFrame:
    base = F.filter("found", lambda x: x["kind"] != "novel")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    count = [F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return scanned.select("doc_id", *count, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
