"""Nearest neighbours by cosine with additive quantisation.

Fit: codebooks of full-dimensional vectors, one after another on what the former
leave over (k-means on a bounded sample, ``sample`` vectors).  Index: every vector
is scaled to length one and encoded by beam search over the codebooks; its codes
and the norm of its reconstruction are stored.  Search: queries are taken in
blocks; for a block a table of dot products with all code words is built, a
block of the index is scored by table look-ups divided by the stored norms, the
best ``keep`` of each block go on and are reranked by the exact cosine in double
precision, and the best ``k`` over all blocks are the result.

Equal vectors are indexed once, with the k + 1 smallest of their ids: no result
needs more of them, and a very common vector cannot crowd others out of the
candidates.  Vectors and queries are dealt to blocks by their hashes, ``block_rows``
and ``query_rows`` on average; a query block meets each index block once, so a task
holds one of each whatever the number of queries.  Nothing is gathered on the
driver but the sample.

Defined results: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part, nor do rows with a null id; rows that
repeat an id count once (the least vector); with fewer than k candidates all are
returned; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


class Codebooks:
    """Additive codebooks, each of full dimension."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)  # codebooks x words x dimension
        self.flat = self.books.reshape(-1, books.shape[2])
        self.dots = self.flat @ self.flat.T

    @classmethod
    def fit(cls, x: np.ndarray, books: int = 16, words: int = 256, rounds: int = 6, seed: int = 0) -> Codebooks:
        rng = np.random.default_rng(seed)
        rest, out = x.astype(np.float32).copy(), []
        for _ in range(books):
            c = rest[rng.integers(0, len(rest), words)] + rng.normal(0, 1e-4, (words, x.shape[1])).astype(np.float32)
            for _ in range(rounds):
                near = cls._nearest(rest, c)
                n = np.bincount(near, minlength=words)
                sums = np.zeros_like(c)
                np.add.at(sums, near, rest)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
            rest -= c[cls._nearest(rest, c)]
            out.append(c)
        return cls(np.stack(out))

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        half = (c * c).sum(axis=1) / 2
        return np.concatenate([(x[i : i + 8192] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 8192)])

    def encode(self, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Codes and reconstruction norms by beam search.

        A partial sum's error is its squared norm less twice its dot product with
        the vector; both grow by look-ups as a code word is added.
        """
        m, k, _ = self.books.shape
        half = (self.flat * self.flat).sum(axis=1)
        with_x = x.astype(np.float32) @ self.flat.T
        n = len(x)
        codes, cost, norm = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32), np.zeros((n, 1), np.float32)
        for j in range(m):
            new = np.arange(j * k, (j + 1) * k)
            cross = np.zeros((n, codes.shape[1], k), np.float32)
            for i in range(j):
                cross += self.dots[:, j * k : (j + 1) * k][codes[:, :, i]]
            grown = norm[:, :, None] + half[new] + 2 * cross
            error = grown - 2 * (cost[:, :, None] + with_x[:, None, new])
            flat = error.reshape(n, -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(width), (n, 1))
            parent, word = best // k, best % k
            row = np.arange(n)[:, None]
            codes = np.concatenate((codes[row, parent], new[word][:, :, None]), axis=2)
            norm, cost = grown[row, parent, word], cost[row, parent] + with_x[row, new[word]]
        best = (norm - 2 * cost).argmin(axis=1)
        row = np.arange(n)
        return codes[row, best].astype(np.uint16), np.sqrt(np.maximum(norm[row, best], 1e-12))

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Approximate cosines, queries x vectors, by table look-ups."""
        table = (queries.astype(np.float32) @ self.flat.T).T.copy()  # code words x queries
        out = np.zeros((len(codes), len(queries)), np.float32)
        for j in range(codes.shape[1]):
            out += table[codes[:, j]]
        return (out / norms[:, None]).T


def _usable(column: Column) -> Column:
    """An array with neither a null nor a non-finite component, and a component other than zero."""
    fine = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return column.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(column, lambda v: v != 0), F.lit(False))


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of double): the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = table.filter(F.col(id_col).isNotNull() & _usable(v)).groupBy(F.col(id_col).alias("vec_id")).agg(F.min(v).alias("v"))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (size["n"] if size else 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(rows: DataFrame, sample: int = 20_000, numbers: int = 1 << 24, **options) -> Codebooks | None:
    """Codebooks from a sample by hash: at most ``sample`` vectors and ``numbers`` components."""
    total, first = rows.count(), rows.select(F.size("v").alias("n")).first()
    if not total:
        return None
    most = max(1, min(sample, numbers // first["n"]))
    draw = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.filter(draw <= min(1.0, most / total)).select("v").limit(most).toArrow()
    if not picked.num_rows:
        picked = rows.select("v").limit(most).toArrow()
    flat = picked.column("v").combine_chunks().flatten().to_numpy()
    return Codebooks.fit(_unit(flat.reshape(-1, first["n"])), **options)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """v, ids: each different vector with its k + 1 smallest ids (the limit is applied before the shuffle too)."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def index(vectors: DataFrame, books: Codebooks, beam: int = 4) -> DataFrame:
    """v, ids, codes, norm of every different vector."""
    kind = vectors.schema["ids"].dataType.simpleString()
    shared = vectors.sparkSession.sparkContext.broadcast(books.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                x = _unit(b.column(0).flatten().to_numpy().reshape(b.num_rows, -1))
                codes, norms = own.encode(x, beam)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32())], ["v", "ids", "codes", "norm"])

    return vectors.select("v", "ids").mapInArrow(run, f"v array<double>, ids {kind}, codes binary, norm float")


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact cosines of each query with its own candidates (queries x candidates x dimension)."""
    q, x = q / np.abs(q).max(axis=1, keepdims=True), x / np.abs(x).max(axis=2, keepdims=True)
    return np.einsum("qd,qcd->qc", q, x) / np.sqrt((q * q).sum(axis=1)[:, None] * (x * x).sum(axis=2))


def search(indexed: DataFrame, queries: DataFrame, books: Codebooks, k: int = 5, keep: int = 200, block_rows: int = 10_000, query_rows: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score for each row of ``queries`` (vec_id, v)."""
    blocks, sets = max(1, -(-indexed.count() // block_rows)), max(1, -(-queries.count() // query_rows))
    kind = queries.schema["vec_id"].dataType.simpleString()
    shared = queries.sparkSession.sparkContext.broadcast(books.books)

    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if not queries.empty and not block.empty:
            own = Codebooks(shared.value)
            block = block.assign(least=block["ids"].str[0]).sort_values("least", kind="stable")
            ids, least, x = block["ids"].tolist(), block["least"].to_numpy(), np.array(block["v"].tolist())
            codes, norms = np.frombuffer(b"".join(block["codes"]), np.uint16).reshape(len(ids), -1), block["norm"].to_numpy()
            q_ids, q = queries["vec_id"].tolist(), np.array(queries["v"].tolist())
            most = min(keep, len(ids))
            for lo in range(0, len(q), 64):
                part = q[lo : lo + 64]
                score = own.scores(_unit(part), codes, norms)
                near = np.argsort(-score, axis=1, kind="stable")[:, :most]
                exact = _cosines(part, x[near])
                # the query's own vector may hold no other id, so one more vector than ids
                order = np.lexsort((least[near], -exact), axis=1)[:, : k + 1]
                for n, own_id in enumerate(q_ids[lo : lo + 64]):
                    found = [(-exact[n, j], i) for j in order[n] for i in ids[near[n, j]] if i != own_id]
                    out += [(own_id, i, -s) for s, i in sorted(found)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def one_of(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    left = queries.select("vec_id", "v", one_of("vec_id", sets).alias("a"), all_of(blocks).alias("b"))
    right = indexed.select("v", "ids", "codes", "norm", one_of("v", blocks).alias("b"), all_of(sets).alias("a"))
    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(run, f"query_id {kind}, vec_id {kind}, score double")
    # a limit on the rank is applied before the shuffle too
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(table: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """The k nearest of each row whose id is divisible by ``every``, among all other rows."""
    rows = cut(vectors(table, id_col, vector_col))
    books = fit(rows)
    if books is None:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    indexed = cut(index(distinct_vectors(rows, k), books))
    return search(indexed, rows.filter(F.col("vec_id") % every == 0), books, k, **options)
