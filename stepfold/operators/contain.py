"""Which texts contain which items, through an equi-join on the rarest part of each item.

An item of seven or more words that stands in a text has its second to last but one
words there as whole words, so each run of five of them is a key that the text has too.
A key is a 64-bit hash of its text and kind.  Prefix sums of bytes times powers of an odd
number give the hash of every run of a text at once (numpy, Arrow batches); two runs of one hash are
at worst a candidate more, as what is found is held against the whole item.

Which of an item's keys is the rarest is found before anything is joined: the keys of
all texts are counted by slots of the hash (``SLOTS`` of them, so the counts are bounded
whatever the corpus), those slots that some item's key falls into.  A slot's count is at least a
key's, so a common key looks common.  Texts send only keys in slots that an item asks for: a
bitmap of slots (128 KB) drops the others where texts are read.  Items all of whose keys are common
are asked for in ``SALTS`` parts of the texts.  Shorter items have one key: their inner
words, or their first characters where no word need be whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOTS = 1 << 20
SALTS = 64
RUN = 5
#: A key is common if its slot has more than this share of all keys, and more than ``COMMON_LEAST``.
COMMON_SHARE, COMMON_LEAST = 1 / 4096, 1000


def _words(text: Column) -> Column:
    return F.split(text, " ")


#: An odd number and its inverse modulo 2^64; texts are hashed in pieces of about so many bytes (a longer text is one piece).
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_PIECE = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64; kept for pieces of the usual size."""
    table = _powers.get(base)
    if table is None or len(table) <= n:
        table = np.full(max(n, _PIECE) + 1, base, np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        if n <= _PIECE:
            _powers[base] = table
    return table


def _code(unit: str, n: int) -> int:
    return n + (0 if unit == "words" else 32)


def _mixed(h: np.ndarray, code: np.ndarray | np.uint64) -> np.ndarray:
    """The hash of a run and its kind, spread over all bits."""
    h = h + code * np.uint64(0xD1B54A32D192ED03)
    for by, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(by))) * np.uint64(odd)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


class _Piece:
    """Some texts, end to end, with the prefix sums of their bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        n = len(self.data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.data.astype(np.uint64) * _power_table(_ODD, n)[:n], out=self.sums[1:])
        self.back = _power_table(_INVERSE, n)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def units(self, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and end of each word (one space parts two) or character."""
        o = self.offsets
        at = np.flatnonzero(self.data == 32 if unit == "words" else (self.data & 0xC0) != 0x80)
        where = np.searchsorted(o[1:], at, "right")
        if unit == "chars":
            end = np.append(at[1:], 0)
            last = np.append(where[1:] != where[:-1], True)[: len(at)]
            return where, at, np.where(last, o[where + 1], end[: len(at)])
        counts = np.bincount(where, minlength=len(o) - 1) + 1
        upto = np.cumsum(counts)
        start, end = np.empty(upto[-1], np.int64), np.empty(upto[-1], np.int64)
        first, last = np.zeros(len(start), bool), np.zeros(len(start), bool)
        first[upto - counts], last[upto - 1] = True, True
        start[first], start[~first] = o[:-1], at + 1
        end[last], end[~last] = o[1:], at
        return np.repeat(np.arange(len(counts)), counts), start, end

    def keys(self, unit: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Text and key of each run of ``n`` words or characters."""
        code = np.uint64(_code(unit, n))
        if n == 0:
            rows = np.arange(len(self.offsets) - 1)
            return rows, _mixed(np.zeros(len(rows), np.uint64), code)
        row, start, end = self.units(unit)
        k = max(len(row) - n + 1, 0)
        i = np.flatnonzero(row[:k] == row[n - 1 : n - 1 + k])
        return row[i], _mixed(self.hashes(start[i], end[i + n - 1]), code)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, _Piece]]:
    """The texts of an Arrow array (without nulls) in pieces, with the place of the first text of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(int(np.searchsorted(offsets, offsets[at] + _PIECE, "right")) - 1, at + 1)
        to = min(to, len(texts))
        yield at, _Piece(data, offsets[at : to + 1])
        at = to


def _hashed(part: Column, code: Column) -> Column:
    """The keys of whole parts and their kinds' codes."""

    @F.pandas_udf("bigint")
    def hashed(part: pd.Series, code: pd.Series) -> pd.Series:
        found = [p.hashes(p.offsets[:-1], p.offsets[1:]) for _, p in _pieces(pa.array(part, pa.string()))]
        return pd.Series(_mixed(np.concatenate([np.zeros(0, np.uint64), *found]), code.to_numpy().astype(np.uint64)))

    return hashed(part, code)


def _key(unit: str, n: Column | int, text: Column) -> Column:
    return F.struct(F.lit(unit).alias("unit"), (F.lit(n) if isinstance(n, int) else n).cast("int").alias("n"), text.alias("part"))


def slot(key: str) -> Column:
    return F.pmod(F.col(key), F.lit(SLOTS)).cast("int")


def _parts(items: DataFrame) -> DataFrame:
    """item_id, item, key (unit, n, part): the parts of each item (item_id, item), any of which a text that contains it must have."""
    w = items.filter("item IS NOT NULL").withColumn("w", _words(F.col("item"))).withColumn("n", F.size("w"))
    runs = F.transform(F.sequence(F.lit(2), F.greatest(F.col("n") - RUN, F.lit(2))), lambda i: _key("words", RUN, F.array_join(F.slice("w", i, RUN), " ")))
    inner, first = F.array_join(F.slice("w", 2, F.greatest(F.col("n") - 2, F.lit(0))), " "), F.least(F.length("item"), F.lit(16))
    few = _key("words", F.col("n") - 2, inner)
    chars = _key("chars", first, F.left("item", first))
    keys = F.when(F.col("n") > RUN + 1, F.array_distinct(runs)).when(F.col("n") > 2, F.array(few)).otherwise(F.array(chars))
    return w.select("item_id", "item", F.explode(keys).alias("key"))


def item_keys(items: DataFrame) -> DataFrame:
    """item_id, item, key: the keys of each item (item_id, item)."""
    code = F.col("key.n") + F.when(F.col("key.unit") == "words", 0).otherwise(32)
    return _parts(items).select("item_id", "item", _hashed(F.col("key.part"), code).alias("key"))


def asked_slots(keys: DataFrame) -> bytes:
    """A bitmap of the slots of some keys, ``SLOTS`` bits."""
    at = keys.select(slot("key").alias("slot"))
    found = at.groupBy((F.col("slot") / 32768).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits")).collect()  # 32 rows at most
    out = bytearray(SLOTS // 8)
    for r in found:
        out[r["b"] * 4096 : (r["b"] + 1) * 4096] = r["bits"]
    return bytes(out)


def text_keys(texts: DataFrame, kinds: list[tuple[str, int]], asked: bytes | None = None) -> DataFrame:
    """doc_id, key: each different key of each text (doc_id, text), of the kinds asked for; of ``asked`` slots (a bitmap) only, if given."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if asked is None else np.unpackbits(np.frombuffer(asked, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            for first, piece in _pieces(batch.column("text")):
                rows, keys = [], []
                for kind in kinds:
                    r, k = piece.keys(*kind)
                    if wanted is not None:
                        good = wanted[k & (SLOTS - 1)]
                        r, k = r[good], k[good]
                    rows.append(r)
                    keys.append(k)
                row, key = np.concatenate(rows), np.concatenate(keys)
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                yield pa.record_batch([batch.column("doc_id").take(pa.array(row[new] + first)), pa.array(key[new])], names=["doc_id", "key"])

    schema = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), T.StructField("key", T.LongType())])
    return texts.filter("text IS NOT NULL").select("doc_id", "text").mapInArrow(found, schema)


def rarest(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """item_id, item, key, n: each item's key in the emptiest slot; ties go to the least key."""
    each = keys.withColumn("slot", slot("key")).join(counts, "slot", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = F.min(F.struct("n", "key"))
    return each.groupBy("item_id", "item").agg(best.alias("b")).select("item_id", "item", "b.key", "b.n")


def dealt(keys: DataFrame, probes: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join with their ``salt``: of the texts' keys only those in slots that are asked for."""
    common = F.col("n") > max(total * COMMON_SHARE, COMMON_LEAST)
    asked = probes.select(slot("key").alias("slot"), common.alias("common")).groupBy("slot").agg(F.max("common").alias("common"))
    salt = F.when(F.col("common"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    # at most SLOTS rows of five bytes
    left = keys.withColumn("slot", slot("key")).join(F.broadcast(asked), "slot").select("doc_id", "key", salt.alias("salt"))
    # an item's own slot may be common through another item's key
    right = probes.select("item_id", "item", "key", slot("key").alias("slot")).join(F.broadcast(asked), "slot")
    salts = F.explode(F.when(F.col("common"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return left, right.select("item_id", "item", "key", salts.alias("salt"))


def contained(texts: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: each text (doc_id, text) with each item (item_id, item) that stands in it; nulls contain nothing."""
    keys = item_keys(items)
    kinds = sorted((r["unit"], r["n"]) for r in _parts(items).select("key.unit", "key.n").distinct().collect())  # of words up to 5, of characters up to 16
    if not kinds:
        return texts.select("doc_id").crossJoin(items.select("item_id").limit(0))
    counts = text_keys(texts, kinds, asked_slots(keys)).groupBy(slot("key").alias("slot")).agg(F.count("*").alias("n")).persist()
    # about as many keys as all texts have
    size = sum((F.length("text") - F.length(F.translate("text", " ", "")) + 1 if unit == "words" else F.length("text") for unit, _ in kinds), F.lit(0))
    total = texts.agg(F.sum(size)).first()[0] or 0
    probes = rarest(keys, counts)
    left, right = dealt(text_keys(texts, kinds, asked_slots(probes)), probes, total)
    pairs = left.join(right, ["key", "salt"]).select("doc_id", "item_id", "item").distinct()
    return pairs.join(texts, "doc_id").filter(F.contains("text", "item")).select("doc_id", "item_id")
