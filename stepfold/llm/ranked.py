"""Ranked lexical search by Block-Max WAND.

Index: documents are read in place, partition by partition, into shards of at most
``shard_postings`` postings (no shuffle).  Within a shard documents are numbered in the
order of their ids.  A term's postings are cut into blocks of 128; a block keeps its
first and last document, its largest impact, and its gaps and frequencies in a
variable-byte code.  An impact is ``(1000000000 tf) div (1000 tf + 8 m)``, what a
posting gives before the term's weight.  A shard is one row for its documents and one
for each term.

Search: each query term's document frequency comes from the index.  For every shard and
set of queries a task has the posting lists of the terms asked for there and runs
Block-Max WAND: lists are ordered by their cursors, the pivot is the first document that
the lists' largest scores could lift over the threshold (the k-th best score so far); a
shallow move of the block pointers gives the sum of block maxima there, and where that
fails the cursors go on past the nearest block's end without decompressing anything; else
the blocks are decompressed (once a shard) and the document is scored.  All queries of a set
move in step, a numpy operation at a time.  The shards' best k of a query are then
ranked together.  Skipping is exact: the result is that of scoring everything.

Defined results: null texts, and texts without terms, are no documents (they count
neither in N nor in L) and no queries; a query term that no document holds gives nothing;
repeated rows are documents, or queries, of their own; ties go to the smaller id (a null
id last); long texts are read whole; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_keys, lookup, salted_join, text_or_empty

#: ASCII letters and digits (A-Z as a-z) and all bytes of other characters stand, the rest parts terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
BLOCK = 128
GAIN = 10**9


def terms(text: str) -> list[bytes]:
    """The terms of a text, with repeats, in UTF-8."""
    return text.encode().translate(_TERM_BYTES).split()


def totals(documents: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """N and L: documents with a term, and terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = size = 0
        for b in batches:
            for t in b.column(0):
                k = len(terms(t.as_py()))
                n, size = n + (k > 0), size + k
        yield pa.RecordBatch.from_pydict({"n": [n], "size": [size]}, schema=pa.schema([("n", pa.int64()), ("size", pa.int64())]))

    found = documents.select(text_or_empty(text_col)).mapInArrow(run, "n bigint, size bigint").agg(F.sum("n"), F.sum("size")).first()
    return found[0] or 0, found[1] or 0


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-byte code of non-negative numbers (the last byte of each has its high bit clear), and where each begins, with the end."""
    wide = np.ones(len(values), np.int64)
    for k in range(1, 9):
        wide += values >> (7 * k) > 0
    at = np.concatenate(([0], np.cumsum(wide)))
    out = np.empty(at[-1], np.uint8)
    for k in range(int(wide.max(initial=1))):
        some = wide > k
        out[at[:-1][some] + k] = (values[some] >> (7 * k)) & 127 | np.where(wide[some] > k + 1, 128, 0)
    return out, at


def unpacked(data: np.ndarray) -> np.ndarray:
    first = np.concatenate(([0], np.flatnonzero(data < 128) + 1))
    shift = np.arange(len(data)) - np.repeat(first[:-1], np.diff(first))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * shift, first[:-1]) if len(data) else np.empty(0, np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return GAIN * tf // (1000 * tf + 8 * m)


HEAD = 5  # numbers of a block's head: first and last document, largest impact, postings, end of its bytes


class Shard:
    """Documents read so far, as numbers of terms and frequencies."""

    def __init__(self, name: int):
        self.name, self.ids, self.number, self.of, self.tf, self.held = name, [], {}, [], [], 0

    def add(self, own: object, counts: Counter) -> None:
        number = self.number
        self.ids.append(own)
        self.of.append(np.fromiter((number.setdefault(t, len(number)) for t in counts), np.int32, len(counts)))
        self.tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.held += len(counts)

    def rows(self, n: int, total: int) -> Iterator[tuple]:
        """(shard, term, df, heads, body, ids): the documents' ids and m, then each term."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i]))
        m = np.array([10 + 90 * int(self.tf[i].sum()) * n // total for i in order], np.int64)
        yield self.name, None, len(order), b"", m.tobytes(), [self.ids[i] for i in order]
        of, tf = np.concatenate([self.of[i] for i in order]), np.concatenate([self.tf[i] for i in order])
        doc = np.repeat(np.arange(len(order)), [len(self.of[i]) for i in order])
        by = np.argsort(of, kind="stable")
        of, tf, doc = of[by], tf[by], doc[by]
        start = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]))
        df = np.diff(start)
        place = np.arange(len(of)) - np.repeat(start[:-1], df)
        begin = np.flatnonzero(place % BLOCK == 0)
        size = np.diff(np.concatenate((begin, [len(of)])))
        gap = doc - np.concatenate(([0], doc[:-1]))
        gap[begin] = 0
        pair = np.empty(2 * len(of), np.int64)  # a block's gaps, then its frequencies
        slot = np.arange(len(of)) + np.repeat(begin, size)
        pair[slot], pair[slot + np.repeat(size, size)] = gap, tf
        body, at = packed(pair)
        lists = np.searchsorted(begin, start)  # a list's first block
        ends = at[2 * (begin + size)]
        from_ = at[2 * start]
        heads = np.stack((doc[begin], doc[begin + size - 1], np.maximum.reduceat(impacts(tf, m[doc]), begin), size, ends - np.repeat(from_[:-1], np.diff(lists))), axis=1)
        for k, term in enumerate(self.number):
            yield self.name, term, int(df[k]), heads[lists[k] : lists[k + 1]].tobytes(), body[from_[k] : from_[k + 1]].tobytes(), None


def index(documents: DataFrame, n: int, total: int, id_col: str = "doc_id", text_col: str = "text", shard_postings: int = 1 << 20) -> DataFrame:
    """shard, term, df, heads, body, ids; ``n`` and ``total`` are N and L of all documents."""
    rows = documents.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["shard", "term", "df", "heads", "body", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(shard: Shard, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            schema = pa.schema(list(zip(names, [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(id_type)], strict=True)))
            out, size = [], 0
            for row in shard.rows(n, total):
                out.append(row)
                size += len(row[3]) + len(row[4]) + 64
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        shard = Shard(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for own, text in zip(batch.column(0), batch.column(1), strict=True):
                counts = Counter(terms(text.as_py()))
                if counts:
                    shard.add(own.as_py(), counts)
                if shard.held >= shard_postings:
                    yield from flush(shard, batch.schema.field(0).type)
                    shard = Shard(shard.name + 1)
        if shard.held:
            yield from flush(shard, batch.schema.field(0).type)

    return rows.mapInArrow(run, f"shard bigint, term binary, df bigint, heads binary, body binary, ids array<{kind}>")


class Lists:
    """The posting lists of a shard that a set of queries asks for; blocks are decompressed when they are first read."""

    def __init__(self, heads: list[bytes], bodies: list[bytes], m: np.ndarray):
        each = [np.frombuffer(h, np.int64).reshape(-1, HEAD) for h in heads]
        self.m, self.n = m, len(m)
        self.start = np.concatenate(([0], np.cumsum([len(h) for h in each]))).astype(np.int64)  # a list's first block
        head = np.concatenate(each) if each else np.empty((0, HEAD), np.int64)
        self.first, self.last, self.top, self.size, ends = (np.ascontiguousarray(c) for c in head.T)
        self.best = np.array([h[:, 2].max() for h in each], np.int64)
        base = np.concatenate(([0], np.cumsum([len(b) for b in bodies])))[:-1].astype(np.int64)
        self.body = np.frombuffer(b"".join(bodies), np.uint8)
        self.to = ends + np.repeat(base, np.diff(self.start))
        self.at = np.concatenate(([0], np.cumsum(self.size))).astype(np.int64)  # a block's first posting
        self.ready = np.zeros(len(head), bool)
        self.doc, self.gain = np.empty(self.at[-1], np.int64), np.empty(self.at[-1], np.int64)
        self.key = np.repeat(np.arange(len(each)), np.diff(self.start)) * (self.n + 1) + self.last

    def block(self, lists: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The first block of each list that ends at or after a document; the list's end if there is none.  Heads only."""
        return np.minimum(np.searchsorted(self.key, lists * (self.n + 1) + doc), self.start[lists + 1])

    def read(self, blocks: np.ndarray) -> None:
        new = np.unique(blocks[~self.ready[blocks]])
        if not len(new):
            return
        from_ = np.where(new > 0, self.to[new - 1], 0)
        wide = self.to[new] - from_
        numbers = unpacked(self.body[np.repeat(from_ - np.concatenate(([0], np.cumsum(wide)[:-1])), wide) + np.arange(wide.sum())])
        size = self.size[new]
        before = np.concatenate(([0], np.cumsum(size)[:-1]))
        slot = np.arange(size.sum()) + np.repeat(before, size)
        gap, tf = numbers[slot], numbers[slot + np.repeat(size, size)]
        run = np.cumsum(gap)
        doc = run - np.repeat(run[before], size) + np.repeat(self.first[new], size)
        into = np.arange(size.sum()) + np.repeat(self.at[new] - before, size)
        self.doc[into], self.gain[into] = doc, impacts(tf, self.m[doc])
        self.ready[new] = True

    def seek(self, blocks: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The posting of each block (decompressed, ending at or after the document) that is first at or after it."""
        lo, hi = self.at[blocks], self.at[blocks + 1] - 1
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = self.doc[mid] < doc
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return lo


def best(lists: Lists, of: list[np.ndarray], weights: list[np.ndarray], k: int, cells: int = 1 << 15) -> list[list[tuple[int, int]]]:
    """(score, document) of the k best of each query, given the lists and weights of its terms."""
    out: list[list[tuple[int, int]]] = [[] for _ in of]
    order = sorted(range(len(of)), key=lambda q: len(of[q]))
    while order:  # queries of like length move in step
        wide = max(1, len(of[order[-1]]))
        some = order[-max(1, cells // wide) :]
        del order[-len(some) :]
        _wand(lists, of, weights, k, some, out)
    return out


def _wand(lists: Lists, of: list[np.ndarray], weights: list[np.ndarray], k: int, some: list[int], out: list[list[tuple[int, int]]]) -> None:
    end, wide = lists.n, max(len(of[q]) for q in some)
    if not wide or not end:
        return
    term, weight = np.zeros((len(some), wide), np.int64), np.zeros((len(some), wide), np.int64)
    cursor = np.full((len(some), wide), end)
    for r, q in enumerate(some):
        n = len(of[q])
        term[r, :n], weight[r, :n], cursor[r, :n] = of[q], weights[q], lists.first[lists.start[of[q]]]
    most = weight * lists.best[term]
    name, score, where = np.array(some), np.zeros((len(some), k), np.int64), np.full((len(some), k), -1)
    row = np.arange(len(some))
    while len(name):
        need = score.min(axis=1) + 1  # documents come in order, so an equal score is too late
        by = np.argsort(cursor, axis=1)
        reach = np.cumsum(most[row[:, None], by], axis=1) >= need[:, None]
        pivot = cursor[row, by[row, reach.argmax(axis=1)]]
        over = ~reach[:, -1] | (pivot >= end)
        if over.any():
            for r in np.flatnonzero(over).tolist():
                out[name[r]] = sorted(((int(s), int(d)) for s, d in zip(score[r], where[r], strict=True) if d >= 0), key=lambda x: (-x[0], x[1]))
            left = ~over
            name, score, where, term, weight, cursor, most, need, pivot = (x[left] for x in (name, score, where, term, weight, cursor, most, need, pivot))
            row = np.arange(len(name))
            if not len(name):
                return
        # shallow: block pointers of the lists before or at the pivot
        r, c = np.nonzero(cursor <= pivot[:, None])
        held = term[r, c]
        block = lists.block(held, pivot[r])
        live = block < lists.start[held + 1]
        cursor[r[~live], c[~live]] = end
        r, c, held, block = r[live], c[live], held[live], block[live]
        bound = np.bincount(r, weight[r, c] * lists.top[block], len(name)).astype(np.int64)
        fail = bound < need
        skip = fail[r]
        if skip.any():  # past the nearest end of a block, or to the next list's cursor
            to = np.where(cursor > pivot[:, None], cursor, end).min(axis=1)
            np.minimum.at(to, r[skip], lists.last[block[skip]] + 1)
            rs, cs = r[skip], c[skip]
            cursor[rs, cs] = np.maximum(to[rs], lists.first[block[skip]])
        r, c, block = r[~skip], c[~skip], block[~skip]
        if not len(r):
            continue
        # deep: the pivot's document is scored and the cursors move past it
        lists.read(block)
        post = lists.seek(block, pivot[r])
        doc = lists.doc[post]
        hit = doc == pivot[r]
        got = np.zeros(len(name), np.int64)
        np.add.at(got, r[hit], weight[r[hit], c[hit]] * lists.gain[post[hit]])
        after = post + hit
        inside = after < lists.at[block + 1]
        ahead = np.full(len(r), end)
        ahead[inside] = lists.doc[after[inside]]
        more = ~inside & (block + 1 < lists.start[term[r, c] + 1])
        ahead[more] = lists.first[block[more] + 1]
        cursor[r, c] = ahead
        better = np.flatnonzero(got >= need)
        low = score[better] == (need[better] - 1)[:, None]
        worst = np.where(low, where[better], -2).argmax(axis=1)  # of the lowest the last document
        score[better, worst], where[better, worst] = got[better], pivot[better]


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """query (a number of its own), item_id, term: each query's different terms."""
    rows = queries.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).alias("item_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [sorted(set(terms(t.as_py()))) for t in b.column(2)]
            of = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in each]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array([t for x in each for t in x], pa.binary())], ["query", "item_id", "term"])

    return rows.mapInArrow(run, f"query bigint, item_id {rows.schema['item_id'].dataType.simpleString()}, term binary")


def search(indexed: DataFrame, wanted: DataFrame, n: int, k: int = 10, query_rows: int = 1000) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query of ``wanted`` (:func:`query_terms`, computed already)."""
    kind, doc_kind = wanted.schema["item_id"].dataType.simpleString(), indexed.schema["ids"].dataType.elementType.simpleString()
    postings = indexed.filter(F.col("term").isNotNull())
    asked = wanted.groupBy("term").agg(F.count("*").alias("n"))
    shards = postings.groupBy("term").agg(F.sum("df").alias("df"), F.count("*").alias("shards"))
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("bigint")
    known = cut(asked.join(shards, "term").select("term", "n", "shards", weight.alias("weight")))
    queries, rows = wanted.agg(F.countDistinct("query"), F.count("*")).first()
    sets = max(1, -(-queries // query_rows))
    groups = max(1, indexed.filter(F.col("term").isNull()).count())
    schema = pa.schema([("query", pa.int64()), ("item_id", wanted.select("item_id").limit(0).toArrow().schema.field(0).type), ("doc_id", indexed.select(F.get("ids", F.lit(0))).limit(0).toArrow().schema.field(0).type), ("score", pa.int64())])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and held.num_rows:
            asked = asked.sort_by("query")
            query, weight = asked.column("query").to_numpy(), asked.column("weight").to_numpy()
            edge = np.concatenate(([0], np.flatnonzero(query[1:] != query[:-1]) + 1, [len(query)]))
            item, term = asked.column("item_id").take(pa.array(edge[:-1])).to_pylist(), asked.column("term").to_pylist()
            shard, name = held.column("shard").to_numpy(), held.column("term").to_pylist()
            for one in np.unique(shard).tolist():
                rows = np.flatnonzero(shard == one).tolist()
                meta = [r for r in rows if name[r] is None][0]
                rows = [r for r in rows if name[r] is not None]
                ids, m = held.column("ids")[meta].as_py(), np.frombuffer(held.column("body")[meta].as_py(), np.int64)
                number = {name[r]: k for k, r in enumerate(rows)}
                lists = Lists([held.column("heads")[r].as_py() for r in rows], [held.column("body")[r].as_py() for r in rows], m)
                at = np.array([number.get(t, -1) for t in term], np.int64)
                parts = [(at[a:b][at[a:b] >= 0], weight[a:b][at[a:b] >= 0]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                for a, i, top in zip(edge, item, best(lists, [x for x, _ in parts], [w for _, w in parts], k), strict=False):
                    out += [(int(query[a]), i, ids[d], s) for s, d in top]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, schema, strict=True)], schema=schema)

    weighed = lookup(wanted, known.select("term", "n", "weight"), ["term"], "n", max(rows, 1), ["query"])
    weighed = weighed.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(sets)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    lists = known.agg(F.sum("shards")).first()[0] or 1
    held = salted_join(postings, known.select("term"), ["term"], hot_keys(known, ["term"], "shards", lists), ["shard"]).select(*indexed.columns)
    held = held.union(indexed.filter(F.col("term").isNull())).withColumn("g", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    found = weighed.groupBy("g", "part").cogroup(held.groupBy("g", "part")).applyInArrow(run, f"query bigint, item_id {kind}, doc_id {doc_kind}, score bigint")
    # a limit on the rank is applied before the shuffle too
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(documents: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_postings: int = 1 << 20, query_rows: int = 1000) -> DataFrame:
    """The k best documents of each query: item_id, rank (from 1), doc_id, score."""
    n, total = totals(documents, text_col)
    indexed = cut(index(documents, n, max(total, 1), id_col, text_col, shard_postings))
    wanted = cut(query_terms(queries, item_col, item_text_col))
    return search(indexed, wanted, n, k, query_rows)
