"""Near-duplicate vectors by random-hyperplane signs in several tables.

Equal vectors are taken as one node with a number of copies.  The signs of a node's
products with random hyperplanes are its codes, one of ``bits`` bits for each table.
Nodes of equal code in any table meet and the cosine of each such pair is computed
in double precision.  A pair that meets in several tables counts in the first of them
only, so links are counted without being written: a bucket gives a row for each node
(how many vectors it links with there, and a node of its component), never its pairs.
Components are then joined by :func:`stepfold.llm.components.stars`.

Number of tables: two vectors whose cosine is exactly the threshold differ in one sign
with chance acos(threshold) / pi, so they miss each other in all tables with chance
(1 - (1 - acos(threshold) / pi) ** bits) ** tables.  ``tables`` is the least number for
which that is below ``miss``; nearer pairs are missed less often.  ``bits`` grows with
the logarithm of the number of rows, which keeps a bucket's mean size at a few thousand.

A bucket of over ``cap`` nodes is cut into blocks by hash, and each pair of blocks is a
group of its own, so a bucket that holds a third of all rows is many tasks' work.  No pair
is left out, capped or sampled.

Defined results: vectors that are null, zero, or hold null or non-finite components link
with nothing, nor do vectors of different lengths with each other; those rows have no
links and their own id as component.  Each row is a vector, rows that repeat an id too
(they are equal or near like any two, and kept where their id is the component's).
A null id is no component's least unless all its ids are null.  An empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import _usable
from .common import cut, lookup
from .components import stars
from .simhash import _Forest


def plan(rows: int, threshold: float = 0.9, miss: float = 0.001) -> tuple[int, int]:
    """Bits of a code and number of tables for so many rows."""
    bits = max(8, min(31, math.ceil(math.log2(max(rows, 2))) - 12))
    same = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    if same >= 1:
        return bits, 1
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-(same**bits))))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors with a largest component of one: their squares neither overflow nor vanish."""
    return x / np.abs(x).max(axis=1, keepdims=True)


def codes(nodes: DataFrame, bits: int, tables: int, seed: int = 0) -> DataFrame:
    """``nodes`` (node, copies, v, ...) with ``codes``: an int for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(bits)).astype(np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                v = b.column("v")
                sizes = np.diff(v.offsets.to_numpy())
                flat = v.flatten().to_numpy(zero_copy_only=False).astype(float)
                ends = np.cumsum(sizes)
                out = np.empty((b.num_rows, tables), np.int32)
                for n in np.unique(sizes).tolist():
                    if n not in planes:
                        planes[n] = np.random.default_rng((seed, n)).normal(size=(n, tables * bits))
                    at = np.flatnonzero(sizes == n)
                    x = _scaled(flat[(ends[at] - n)[:, None] + np.arange(n)])
                    out[at] = ((x @ planes[n] >= 0).reshape(len(at), tables, bits) @ weights).astype(np.int32)
                each = pa.ListArray.from_arrays(np.arange(0, out.size + 1, tables, dtype=np.int32), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, each], [*b.schema.names, "codes"])

    fields = ", ".join(f"{c} {t}" for c, t in nodes.dtypes)
    return nodes.mapInArrow(run, f"{fields}, codes array<int>")


def _dealt(coded: DataFrame, tables: int, cap: int) -> DataFrame:
    """Each node in its bucket of each table; t, code, dim, a, b name the group, ``own`` is the node's block."""
    each = coded.select("node", "copies", "v", "codes", F.size("v").alias("dim"), F.posexplode("codes").alias("t", "code"))
    sizes = coded.select(F.size("v").alias("dim"), F.posexplode("codes").alias("t", "code")).groupBy("t", "code", "dim").count()
    large = sizes.filter(F.col("count") > cap).select("t", "code", "dim", F.ceil(F.col("count") / cap).cast("int").alias("blocks"))
    # Spark broadcasts the large buckets if they are few by its own measure, else joins by key and splits what is skewed
    each = each.join(large, ["t", "code", "dim"], "left")
    own = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = each.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return each.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("other", "blocks")


def bucket_links(x: np.ndarray, own: np.ndarray, copies: np.ndarray, code: np.ndarray, t: int, a: int, b: int, threshold: float, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes of a group: the vectors each links with that did not meet in an earlier table, and the root of each by position.

    In a group of two blocks only pairs across them count; each block alone is another group.
    """
    n = len(x)
    count, forest = np.zeros(n, np.int64), _Forest(n)
    square = (x * x).sum(axis=1)
    order = np.arange(n)
    left, right = (order, order) if a == b else (order[own == a], order[own == b])
    step = max(1, chunk // max(1, len(right)))
    y, y_square = x[right], square[right]
    for lo in range(0, len(left), step):
        rows = left[lo : lo + step]
        near = (x[rows] @ y.T) / np.sqrt(square[rows][:, None] * y_square) >= threshold
        i, j = np.nonzero(near)
        i, j = rows[i], right[j]
        if a == b:
            i, j = i[i < j], j[i < j]
        for k in range(t):  # pairs that met before
            if not len(i):
                break
            new = code[i, k] != code[j, k]
            i, j = i[new], j[new]
        count += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
        forest.unite(i, j)
    return count, forest.root


def links(coded: DataFrame, tables: int, threshold: float = 0.9, cap: int = 4096) -> DataFrame:
    """node, n, root: for each node and group with links, the number of vectors it links with there and a node of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(key: tuple, parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            part = pa.Table.from_batches(parts).combine_chunks()
            if part.num_rows < 2:
                return None
            dim, t, _, a, b = key
            node, own, copies = (part.column(c).to_numpy() for c in ("node", "own", "copies"))
            flat, code = (part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("v", "codes"))
            x = _scaled(flat.astype(float).reshape(-1, dim))
            count, root = bucket_links(x, own, copies, code.reshape(len(x), -1), t, a, b, threshold)
            at = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(count[at]), pa.array(node[root[at]])], ["node", "n", "root"])

        names = ["dim", "t", "code", "a", "b"]
        key, parts = None, []
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in names]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if batch.num_rows > 1 else np.empty(0, int)
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                now = tuple(int(c[lo]) for c in cols)
                if now != key and parts:
                    if (done := of(key, parts)) is not None:
                        yield done
                    parts = []
                key = now
                parts.append(batch.slice(lo, hi - lo))
        if parts and (done := of(key, parts)) is not None:
            yield done

    keys = ["dim", "t", "code", "a", "b"]
    dealt = _dealt(coded, tables, cap).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "node", "own", "copies", "v", "codes").mapInArrow(run, "node bigint, n bigint, root bigint")


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, miss: float = 0.001, seed: int = 0, cap: int = 4096) -> DataFrame:
    """A row for each row: vec_id, n_links, component_id, kept."""
    kind = table.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    good = rows.filter(_usable(F.col("v")))
    bits, tables = plan(table.count(), threshold, miss)
    nodes = good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "least", "copies", "v"))
    coded = cut(codes(nodes.select("node", "copies", "v"), bits, tables, seed))
    found = cut(links(coded, tables, threshold, cap))
    linked = found.groupBy("node").agg(F.sum("n").alias("n"))
    star = stars(cut(found.select(F.col("node").alias("u"), F.col("root").alias("v")).filter("u <> v").distinct()))
    rooted = nodes.join(linked, "node", "left").join(star.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    rooted = cut(rooted.select("v", "least", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    label = lookup(rooted.drop("least"), named, ["root"], "n", max(nodes.count(), 1), ["v"]).select("v", "n_links", "component_id", "copies")
    out = lookup(good, cut(label), ["v"], "copies", good.count(), ["vec_id", F.spark_partition_id()]).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~_usable(F.col("v"))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
