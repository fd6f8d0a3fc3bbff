"""Repeated passages by compressed FM-indexes, one per shard.

A window of ``window`` words that starts at two or more places anywhere is
repeated, and every word it covers is removed.  The steps:

1. Cut.  Each text is cut where the minimiser (the least hash among the
   ``gram``-word sequences of a window) changes value.  Equal windows have equal
   minimisers, so they lie in segments with the same key and one shard can
   decide about them.  Segments whose key occurs once hold nothing repeated.
2. Collapse.  Segments that are equal as a whole are indexed once, with their
   number as weight, so a passage with a million copies costs one.
3. Index.  Each shard (a run of whole keys, bounded in words) concatenates its
   segments, sorts suffixes to the window's depth, takes the BWT, and stores it
   as a wavelet matrix of packed bits with block counts.
4. Search.  Segments are streamed against their shard's index: backward search
   from a window's end gives its matching statistic, up to the window's length,
   over places that hold at least two weights.  Windows that reach the length are
   the repeated ones; their intervals are reported.
5. A key with over ``cap`` different segments (the end of a passage that goes on in
   very many ways) has no shard.  The windows of its segments are told apart by
   128-bit digests, counted by weight in one aggregation, and those that count twice or more are
   joined back: one round whatever the input, and no task holds such a key.  Keys,
   windows and passages with very many copies are salted in joins.

Sorting to the window's depth is enough: backward search uses only numbers of
suffixes before an interval, and intervals of patterns up to that depth are
contiguous.

Defined results: null text has no words; repeated rows count as separate places;
a window may recur within its own document, overlapping itself too; an empty
table gives no rows; a long text is hashed in blocks; other columns are not looked at.
Rows are told apart by 128 bits over id and text, words by 64 bits, segments of one
key by 64 more: with 10**9 different words the chance that any two of them share a
hash is 3 %, and a window is only taken wrongly if all of its 35 words are equal or do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_LEAST, HOT_SHARE, cut, hot_keys, lookup, salted_join, text_or_empty, word_blocks

_U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            with np.errstate(over="ignore"):
                self.up = np.concatenate((self.up, self.up * _U(pow(self.base, k, 1 << 64))))
                self.down = np.concatenate((self.down, self.down * _U(pow(self.inverse, k, 1 << 64))))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(_STEP)


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x ^ (x >> _U(31)) ^ _U(seed)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _ranges(values: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers: the hash of ``[s, e)`` is ``(sums[e] - sums[s]) * down[s]``."""
    up, down = powers.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, a bounded block of bytes at a time."""
    data, out, size = text.encode(), [], 1 << 21
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + size)
        while hi < len(data) and not _IS_SPACE[data[hi]]:
            hi += 1
        part = np.frombuffer(data, np.uint8, hi - lo, lo)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _IS_SPACE[part], [True])).astype(np.int8)))
        s, e = edge[::2], edge[1::2]
        sums, down = _ranges(part.astype(_U) + _U(1), _BYTES)
        out.append(_mix((sums[e] - sums[s]) * down[s] + (e - s).astype(_U) * _U(_STEP)))
        lo = hi
    return np.concatenate(out) if out else np.empty(0, _U)


def segments(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Key, digest, first word, end word and weight of each segment of a word sequence.

    The weight is 2 where the key occurs at several places of the segment, which may
    then repeat a window by itself.
    """
    width = window - gram + 1
    if len(h) < window:
        return tuple(np.empty(0, k) for k in (_U, _U, np.int64, np.int64, np.int64))
    sums, down = _ranges(h, _WORDS)
    grams = _mix((sums[gram:] - sums[:-gram]) * down[: len(h) - gram + 1])
    least, have = grams, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    turn = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]))
    a, b = turn[:-1], turn[1:]
    key, start, end = least[a], a, b - 1 + window
    at = np.arange(width)
    first = a + (grams[a[:, None] + at] == key[:, None]).argmax(axis=1)
    last = (b - 1) + width - 1 - (grams[(b - 1)[:, None] + at[::-1]] == key[:, None]).argmax(axis=1)
    digest = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U), 0x5DEECE66D)
    return key, digest, start, end, np.where(last > first, 2, 1)


class FMIndex:
    """An FM-index over sequences of symbols with weights, for patterns of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, weight: np.ndarray, depth: int):
        """``text``: symbols from 1, each sequence followed by a 0; ``weight``: of each place."""
        n = len(text)
        rank, have = text.astype(np.int64), 1
        while have * 2 <= depth:
            rank = np.unique(rank * (n + 2) + self._shift(rank, have), return_inverse=True)[1] + 1
            have *= 2
        order = np.argsort(rank * (n + 2) + self._shift(rank, depth - have), kind="stable")
        self.before = np.concatenate(([0], np.bincount(text).cumsum()))
        self.weights = np.concatenate(([0], weight[order].cumsum()))
        self._wavelet(text[order - 1])

    @staticmethod
    def _shift(rank: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate((rank[k:], np.zeros(min(k, len(rank)), rank.dtype)))

    def _wavelet(self, bwt: np.ndarray) -> None:
        self.levels, n, symbols = [], len(bwt), np.arange(len(self.before) - 1)
        base = np.zeros(len(symbols), np.int64)
        for k in reversed(range(max(1, int(bwt.max()).bit_length()))):
            bit = (bwt >> k) & 1
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            packed[: (n + 7) // 8] = np.packbits(bit.astype(bool), bitorder="little")
            words = packed.view(_U)
            blocks = np.concatenate(([0], np.bitwise_count(words).cumsum(dtype=np.int64)))
            level = (k, words, blocks, n - int(bit.sum()))
            self.levels.append(level)
            base = self._down(level, symbols, base)
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))
        self.base = base

    @staticmethod
    def _down(level: tuple, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        k, words, blocks, zeros = level
        at = i >> 6
        ones = blocks[at] + np.bitwise_count(words[at] & ((_U(1) << (i & 63).astype(_U)) - _U(1)))
        return np.where((symbol >> k) & 1 == 1, zeros + ones, i - ones)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i of the BWT."""
        for level in self.levels:
            i = self._down(level, symbol, i)
        return i - self.base[symbol]

    def statistics(self, text: np.ndarray, ends: np.ndarray, depth: int, least: int = 2) -> np.ndarray:
        """For each end, how long the longest match to its left is, up to ``depth``.

        A match is a pattern of ``text`` whose places weigh at least ``least``.
        """
        got, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.weights) - 1)
        for step in range(depth):
            c = text[ends[live] - 1 - step]
            both = self.rank(np.concatenate((c, c)), np.concatenate((lo, hi))) if step else np.concatenate((np.zeros(len(c), np.int64), self.before[c + 1] - self.before[c]))
            lo, hi = self.before[c] + both[: len(c)], self.before[c] + both[len(c) :]
            ok = (self.weights[hi] - self.weights[lo] >= least) & (c > 0)
            live, lo, hi = live[ok], lo[ok], hi[ok]
            if not len(live):
                break
            got[live] = step + 1
        return got


def repeated_intervals(words: list[np.ndarray], weights: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """The intervals of each sequence that repeated windows cover, by one FM-index over all of them.

    Windows a window's length apart and the last one are tried first.  Where all of
    a sequence's are repeated they cover it; else each of its windows is tried.
    """
    n = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(n + 1) - (n + 1)
    symbol = np.unique(np.concatenate(words), return_inverse=True)[1] + 1
    text = np.zeros(int((n + 1).sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[start + n] = False
    text[inside] = symbol
    index = FMIndex(text, np.repeat(weights, n + 1), window)

    def tried(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        return index.statistics(text, start[seq] + at + window, window) >= window

    few = -(-n // window)  # starts 0, window, ..., and n - window
    seq = np.repeat(np.arange(len(words)), few)
    at = np.minimum((np.arange(len(seq)) - np.repeat(np.cumsum(few) - few, few)) * window, n[seq] - window)
    whole = np.ones(len(words), bool)
    np.logical_and.at(whole, seq, tried(seq, at))
    rest = np.flatnonzero(~whole)
    out = [[(0, int(k))] if w else [] for k, w in zip(n, whole, strict=True)]
    each = n[rest] - window + 1
    for lo, hi in _runs(each, 1 << 18):
        seq = np.repeat(rest[lo:hi], each[lo:hi])
        at = np.arange(len(seq)) - np.repeat(np.cumsum(each[lo:hi]) - each[lo:hi], each[lo:hi])
        ok = tried(seq, at)
        for s, a in zip(seq[ok].tolist(), at[ok].tolist(), strict=True):
            if out[s] and a <= out[s][-1][1]:
                out[s][-1] = (out[s][-1][0], a + window)
            else:
                out[s].append((a, a + window))
    return out


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``most`` in sum."""
    lo, total = 0, 0
    for i, k in enumerate(sizes.tolist()):
        total += k
        if total >= most:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


_SEGMENT = "h bigint, d bigint, r1 bigint, r2 bigint, s bigint, e bigint, w bigint"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == _U else x, pa.int64())


def _cut_texts(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """All segments of (r1, r2, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                r1, r2 = b.column(0).to_pylist(), b.column(1).to_pylist()
                found = []
                for i in range(b.num_rows):
                    key, digest, s, e, w = segments(word_hashes(b.column(2)[i].as_py()), window, gram)
                    if len(key):
                        found.append((key, digest, np.full(len(key), r1[i]), np.full(len(key), r2[i]), s, e, w))
                    if sum(len(f[0]) for f in found) > 1 << 17 or (found and i == b.num_rows - 1):
                        yield pa.RecordBatch.from_arrays([_signed(np.concatenate(x)) for x in zip(*found, strict=True)], ["h", "d", "r1", "r2", "s", "e", "w"])
                        found = []

    return rows.mapInArrow(run, _SEGMENT)


def _repeated(segs: DataFrame) -> DataFrame:
    """Segments whose key occurs more than once."""
    keys = cut(segs.groupBy("h").agg(F.sum("w").alias("n"), F.count("*").alias("places")).filter("n > 1").drop("n"))
    total = keys.agg(F.sum("places")).first()[0] or 0
    return lookup(segs, keys, ["h"], "places", total, ["r1", "r2", "s"], "left_semi")


def _fetch(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """(h, d, weight, words) of the picked segments, read off their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                for text, spans in zip(b.column(1), b.column(2), strict=True):
                    spans = spans.as_py()
                    h = word_hashes(text.as_py())
                    for lo in range(0, len(spans), 4096):
                        part = spans[lo : lo + 4096]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([x["h"] for x in part], pa.int64()), pa.array([x["d"] for x in part], pa.int64()), pa.array([x["weight"] for x in part], pa.int64()), pa.array([h[x["s"] : x["e"]].tobytes() for x in part], pa.binary())],
                            ["h", "d", "weight", "words"],
                        )

    by_row = picked.groupBy("r1", "r2").agg(F.collect_list(F.struct("h", "d", "weight", "s", "e")).alias("spans"))
    # the same columns as the last join reads, so that both use one exchange of the texts
    return rows.join(by_row, ["r1", "r2"]).select("doc_id", "text", "spans").mapInArrow(run, "h bigint, d bigint, weight bigint, words binary")


def _search(fetched: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(h, d, s, e): the repeated intervals of each different segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(rows: list[tuple]) -> pa.RecordBatch:
            found = repeated_intervals([np.frombuffer(x[3], _U) for x in rows], np.array([x[2] for x in rows], np.int64), window)
            flat = [(x[0], x[1], s, e) for x, spans in zip(rows, found, strict=True) for s, e in spans]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*flat, strict=True) if flat else ((), (), (), ()))], ["h", "d", "s", "e"])

        held, n, last = [], 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] == last:
                    continue  # the same row of the table, given twice
                if n >= shard_words and row[0] != last[0]:
                    yield shard(held)
                    held, n = [], 0
                held.append(row)
                n += len(row[3]) // 8
                last = row[:2]
        if held:
            yield shard(held)

    dealt = fetched.repartition("h").sortWithinPartitions("h", "d")
    return dealt.select("h", "d", "weight", "words").mapInArrow(run, "h bigint, d bigint, s bigint, e bigint")


def _hot(each: DataFrame, cap: int) -> DataFrame:
    """The keys (h) of over ``cap`` different segments."""
    return cut(each.groupBy("h").count().filter(F.col("count") > cap).select("h"))


def _windows(hot: DataFrame, window: int) -> DataFrame:
    """(h, d, at, weight, x1, x2): every window of different segments (h, d, weight, words) with its digests."""

    def digests(h: np.ndarray, mixed: int) -> np.ndarray:
        sums, down = _ranges(_mix(h, mixed), _WORDS)
        return _mix((sums[window:] - sums[:-window]) * down[: len(h) - window + 1], mixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows_at_once = ["h", "d", "at", "weight", "x1", "x2"], 1 << 17
        with np.errstate(over="ignore"):
            for b in batches:
                held, n = [], 0
                for h, d, weight, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    own = np.frombuffer(words, _U)
                    k = len(own) - window + 1
                    held.append((np.full(k, h), np.full(k, d), np.arange(k), np.full(k, weight), digests(own, 0x1234567), digests(own, 0x89ABCDE)))
                    n += k
                    if n >= rows_at_once:
                        yield pa.RecordBatch.from_arrays([_signed(np.concatenate(c)) for c in zip(*held, strict=True)], names)
                        held, n = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate(c)) for c in zip(*held, strict=True)], names)

    return hot.select("h", "d", "weight", "words").mapInArrow(run, "h bigint, d bigint, at bigint, weight bigint, x1 bigint, x2 bigint")


def _by_windows(hot: DataFrame, window: int) -> DataFrame:
    """(h, d, s, e): the repeated intervals of the segments (h, d, weight, words) of keys over ``cap``."""
    each = _windows(hot, window)
    counts = cut(each.groupBy("x1", "x2").agg(F.sum("weight").alias("n"), F.count("*").alias("places")).filter("n > 1").drop("n"))
    total = counts.agg(F.sum("places")).first()[0] or 0
    again = lookup(each, counts, ["x1", "x2"], "places", total, ["h", "d", "at"], "left_semi")
    # neighbouring windows are one interval
    island = F.col("at") - F.row_number().over(Window.partitionBy("h", "d").orderBy("at"))
    runs = again.select("h", "d", "at", island.alias("island")).groupBy("h", "d", "island")
    return runs.agg(F.min("at").alias("s"), (F.max("at") + window).alias("e")).drop("island")


def _identified(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    key = F.col(id_col).cast("string")
    return documents.select(F.xxhash64(key, text).alias("r1"), F.xxhash64(text, F.lit(1), key).alias("r2"), F.col(id_col).alias("doc_id"), text.alias("text"))


def repeated_spans(rows: DataFrame, window: int = 35, gram: int = 9, cap: int = 20_000, shard_words: int = 300_000) -> DataFrame:
    """(r1, r2, spans): the word intervals of each row (r1, r2, text) to remove."""
    rows = rows.select("r1", "r2", "doc_id", "text")
    segs = cut(_repeated(_cut_texts(rows.select("r1", "r2", "text"), window, gram)))
    each = segs.groupBy("h", "d").agg(F.count("*").alias("weight"), F.min(F.struct("r1", "r2", "s", "e")).alias("x")).select("h", "d", "weight", "x.*")
    over = _hot(each, cap)
    if over.isEmpty():
        found = _search(_fetch(rows, each), window, shard_words)
    else:
        each = cut(each)
        hot = cut(_fetch(rows, each.join(over, "h", "left_semi")).dropDuplicates(["h", "d"]))
        found = _search(_fetch(rows, each.join(over, "h", "left_anti")), window, shard_words).unionByName(_by_windows(hot, window))
    found = found.groupBy("h", "d").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    # what is found isn't computed before the last join, so that both read one exchange of the texts
    total = segs.count()
    common = cut(segs.groupBy("h", "d").agg(F.count("*").alias("weight")).filter(F.col("weight") > max(total * HOT_SHARE, HOT_LEAST)))
    spans = salted_join(segs.select("h", "d", "r1", "r2", F.col("s").alias("at")), found, ["h", "d"], hot_keys(common, ["h", "d"], "weight", total), ["r1", "r2", "at"])
    spans = spans.select("r1", "r2", "at", F.explode("spans").alias("x"))
    return spans.groupBy("r1", "r2").agg(F.array_sort(F.collect_set(F.struct((F.col("at") + F.col("x.s")).alias("s"), (F.col("at") + F.col("x.e")).alias("e")))).alias("spans"))


def _kept(text: str, spans: list[dict] | None) -> Iterator[tuple[int, list[bytes]]]:
    """Number of words and those that stay, a block at a time."""
    at, k = 0, 0
    spans = spans or []
    for words in word_blocks(text.encode()):
        keep, pos = [], 0
        while k < len(spans) and spans[k]["s"] < at + len(words):
            s, e = max(spans[k]["s"] - at, pos), spans[k]["e"] - at
            keep += words[pos:s] if s > pos else []
            pos = max(pos, e)
            if e > len(words):
                break
            k += 1
        yield len(words), keep + words[pos:]
        at += len(words)


def remove_repeated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, text: each document's words that stay, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [b" ".join(w for _, ws in _kept(t.as_py(), s.as_py()) for w in ws).decode() for t, s in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = _identified(documents, id_col, text_col)
    joined = rows.join(repeated_spans(rows, **options), ["r1", "r2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, sums = [], [], []
            for t, s in zip(b.column(1), b.column(2), strict=True):
                n = kept = 0
                sha = hashlib.sha256()
                for count, words in _kept(t.as_py(), s.as_py()):
                    sha.update((b" " if kept and words else b"") + b" ".join(words))
                    n, kept = n + count, kept + len(words)
                total.append(n)
                gone.append(n - kept)
                sums.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _identified(documents, id_col, text_col)
    joined = rows.join(repeated_spans(rows, **options), ["r1", "r2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string")
