"""SimHash fingerprints and their near-duplicate components by a binary-trie self-join.

Fingerprints at ``budget`` or fewer differing bits are linked.  The join runs on
distinct fingerprints (exact copies cost nothing).  With budget b the 64 bits
are cut into b + 1 bands; two fingerprints within the budget agree on at least
one band, so each is dealt to b + 1 groups and nothing is missed.  A group that
is too large for one task is dealt again by bands of its remaining bits, which
is as exact.  Within a task all groups are tries over their sorted fingerprints:
node pairs are walked together level by level, differing bits add up, and a
pair whose sum exceeds the budget is dropped with everything below it.  Pairs
of nodes that are already connected are dropped too, so a dense group costs its
spanning forest, not all its pairs.

Defined results: null text counts as empty; a text without words has fingerprint
zero, linked like any other; a component whose ids are all null has a null
component_id; repeated rows give repeated rows; an empty table gives no rows; a long
text is read in blocks; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, text_or_empty, word_blocks
from .components import stars

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return total


def fingerprint(text: str, width: int = 4, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of one text."""
    digest = xxhash.xxh64_intdigest
    counts, n, tail = np.zeros(64, np.int64), 0, []
    for words in word_blocks(text.encode().translate(_LOWER)):
        words = tail + words
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            hashes = [digest(joined[s:e], seed) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
            counts += _bit_counts(np.array(hashes, np.uint64))
            n += len(hashes)
            words = words[len(words) - width + 1 :]
        tail = words
    if n == 0:
        if not tail:
            return 0
        n, counts = 1, _bit_counts(np.array([digest(b" ".join(tail), seed)], np.uint64))
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long), a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = documents.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


class _Forest:
    """Union-find over 0..n-1 with whole-array steps."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        r = self.root
        while True:
            a, b = r[i], r[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(r, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := r[r], r):
                r = up
        self.root = r


def trie_links(groups: np.ndarray, values: np.ndarray, budget: int, chunk: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (as positions) that connect what links connect within each group.

    ``groups`` and ``values`` (unsigned) must be sorted by both; a group's values are
    the leaves of one trie.  Node pairs are ranges of positions.
    """
    n = len(values)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.flatnonzero(groups[1:] != groups[:-1]) + 1
    first, last = np.concatenate(([0], edge)), np.concatenate((edge, [n]))
    many = last - first > 1
    first, last = first[many], last[many]
    forest = _Forest(n)
    ones: dict[int, np.ndarray] = {}

    def split(depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if depth not in ones:
            bit = (values >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
        return hi - (ones[depth][hi] - ones[depth][lo])

    def joined(a0, a1, b0, b1):
        """Whether both nodes lie in one component already."""
        steps = np.concatenate(([0], np.cumsum(forest.root[1:] != forest.root[:-1])))
        return (steps[a1 - 1] == steps[a0]) & (steps[b1 - 1] == steps[b0]) & (forest.root[a0] == forest.root[b0])

    stack = [(0, first, last, first, last, np.zeros(len(first), np.int64))]
    while stack:
        depth, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > chunk:
            stack += [(depth, *(x[k : k + chunk] for x in (a0, a1, b0, b1, diff))) for k in range(0, len(a0), chunk)]
            continue
        rest = ~joined(a0, a1, b0, b1)
        a0, a1, b0, b1, diff = (x[rest] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        size = (a1 - a0) * (b1 - b0)
        leaf = (size <= 64) | (depth == 64)
        if leaf.any():
            n_each = size[leaf]
            of = np.repeat(np.arange(len(n_each)), n_each)
            k = np.arange(len(of)) - np.repeat(np.cumsum(n_each) - n_each, n_each)
            wide = (b1 - b0)[leaf][of]
            i, j = a0[leaf][of] + k // wide, b0[leaf][of] + k % wide
            near = (np.bitwise_count(values[i] ^ values[j]) <= budget) & (i != j)
            forest.unite(i[near], j[near])
        a0, a1, b0, b1, diff = (x[~leaf] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        am, bm, same = split(depth, a0, a1), split(depth, b0, b1), a0 == b0
        same &= a1 == b1
        below = []
        for x0, x1, y0, y1, more, ok in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same)):
            keep = (x1 > x0) & (y1 > y0) & (diff + more <= budget)
            keep = keep if ok is None else keep & ok
            below.append([x0[keep], x1[keep], y0[keep], y1[keep], diff[keep] + more])
        # the pairs with a differing bit come later: what agrees connects most
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*below[2:], strict=True))))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*below[:2], strict=True))))
    member = np.flatnonzero(forest.root != np.arange(n))
    return member, forest.root[member]


def _bands(bits: list[int], parts: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(bits), parts) if len(x)]


def _dealt(nodes: DataFrame, budget: int, cap: int) -> DataFrame:
    """(g, fp): each fingerprint in the groups of its bands; groups over ``cap`` are dealt again."""

    def pick(column, bits):
        mask = sum(1 << b for b in bits)
        return column.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    top = _bands(list(range(64)), budget + 1)
    at = nodes.select("fp", F.explode(F.array(*(F.struct(F.lit(str(k)).alias("path"), pick(F.col("fp"), b).alias("agreed")) for k, b in enumerate(top)))).alias("x")).select("fp", "x.path", "x.agreed")
    out, level = None, {str(k): b for k, b in enumerate(top)}
    while True:
        large = cut(at.groupBy("path", "agreed").count().filter(F.col("count") > cap).select("path", "agreed"))
        done = not level or large.isEmpty()
        part = at if done else at.join(large, ["path", "agreed"], "left_anti")
        part = part.select(F.xxhash64("path", "agreed").alias("g"), "fp")
        out = part if out is None else out.union(part)
        if done:
            return out
        deeper, options = {}, []
        for path, used in level.items():
            left = [b for b in range(64) if b not in used]
            for k, b in enumerate(_bands(left, budget + 1) if len(left) > budget else []):
                deeper[f"{path}.{k}"] = used + b
                options.append((path, f"{path}.{k}", b))
        again = at.join(large, ["path", "agreed"], "left_semi")
        choice = F.array_compact(F.array(*(F.when(F.col("path") == p, F.struct(F.lit(q).alias("path"), F.col("agreed").bitwiseOR(pick(F.col("fp"), b)).alias("agreed"))) for p, q, b in options)))
        at = again.select("fp", F.explode(choice).alias("x")).select("fp", "x.path", "x.agreed")
        level = deeper if max(map(len, deeper.values()), default=64) < 64 else {}


def links(nodes: DataFrame, budget: int = 4, cap: int = 50_000, rows_at_once: int = 1 << 18) -> DataFrame:
    """Edges (u, v) over distinct fingerprints ``fp`` whose components are those of all links."""

    top = np.uint64(1 << 63)  # with this bit turned, the signed order of fp is an unsigned order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(g, v):
            i, j = trie_links(g, v, budget)
            return pa.RecordBatch.from_arrays([pa.array((v[x] ^ top).view(np.int64)) for x in (i, j)], ["u", "v"])

        gs, vs, n = [], [], 0
        for b in batches:
            gs.append(b.column(0).to_numpy())
            vs.append(b.column(1).to_numpy().view(np.uint64) ^ top)
            n += b.num_rows
            if n >= rows_at_once:
                g, v = np.concatenate(gs), np.concatenate(vs)
                end = int(np.searchsorted(g, g[-1]))  # the last group may go on
                if end:
                    yield flush(g[:end], v[:end])
                gs, vs, n = [g[end:]], [v[end:]], len(g) - end
        if n:
            yield flush(np.concatenate(gs), np.concatenate(vs))

    dealt = _dealt(nodes, budget, cap).repartition("g").sortWithinPartitions("g", "fp")
    return dealt.select("g", "fp").mapInArrow(run, "u bigint, v bigint").distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4) -> DataFrame:
    """A row for each row: doc_id, fp, component_id (least doc_id that links reach)."""
    rows = cut(fingerprints(documents, id_col, text_col, width))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    star = stars(cut(links(nodes.select("fp"), budget)))
    rooted = cut(nodes.join(star.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    label = lookup(rooted.drop("least"), named, ["root"], "n", max(rooted.count(), 1), ["fp"]).select("fp", "component_id", "copies")
    return lookup(rows, cut(label), ["fp"], "copies", rows.count(), ["doc_id", F.spark_partition_id()]).select("doc_id", "fp", "component_id")
