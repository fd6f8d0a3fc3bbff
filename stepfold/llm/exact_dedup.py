"""Exact duplicates by an extendible-hash index on shared files (DataFrame functions only).

* Key: XXH64 of the normalised text (white space deleted).
* Directory: an extendible-hash directory over the leading key bits.  It is
  grown by doubling: a bucket with more different keys than its capacity is split,
  and when its local depth equals the directory's, the directory doubles.  It is built
  from a histogram of at most ``2 ** max_depth`` rows, whatever the input's size.
  Unless a capacity is given, buckets hold about a 1,024th of the keys.
* Owners: each has a run of neighbouring buckets, that is a range of keys, with about
  the same number of rows.  Rows look their bucket and owner up in the directory and are
  dealt to the owner's task, which compares the bytes of texts of equal key and
  chains texts that only share a key.  Keys with over a 4,096th of all rows and over
  1,000 (fewer than 4,096 keys) are dealt to all owners; what these make of them, one row for
  each, goes to the true owner, which puts it together by SHA-256.
* The index (bucket, key, digest, row that stays, group size) is written by its
  owners as Parquet in the shared folder, a directory an owner, sorted by bucket and
  key.  Documents find their entry there by owner, bucket, key and digest.

Defined results: null text counts as empty; empty texts equal one another; a
null doc_id comes last among candidates to stay; rows that repeat doc_id and
text are the same document, so all carry the same flags and each counts in
``group_size`` (``survivors`` returns it once).  Ids may be of any type that can be
ordered.  An empty table gives no rows.  Columns other than the id and the text are
not looked at, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_LEAST, HOT_SHARE, SPACE, cut, lookup, shared_dir, text_or_empty

MAX_DEPTH = 16
#: The most keys that a bucket's capacity may be set to where none is given.
MOST = 1 << 20


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text_col), f"[{SPACE}]+", "")


def key_of(norm: Column) -> Column:
    return F.xxhash64(norm)


def slot_of(key: Column, depth: int = MAX_DEPTH) -> Column:
    """The leading ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth).cast("int")


def build_directory(histogram: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[tuple[int, int]]]:
    """Grow the directory until no bucket holds over ``capacity`` keys.

    ``histogram`` maps a slot (leading ``max_depth`` bits) to its number of different
    keys.  Returns the global depth and, for each directory entry, its bucket as
    ``(first slot, local depth)``.  A bucket that is still too full at
    ``max_depth`` is left so.
    """
    totals = [0] * (1 << max_depth)
    for slot, n in histogram.items():
        totals[slot] = n
    prefix = [0]
    for n in totals:
        prefix.append(prefix[-1] + n)
    depth, buckets = 0, [(0, 0)]
    todo = [(0, 0)]
    done: list[tuple[int, int]] = []
    while todo:
        first, local = todo.pop()
        width = 1 << (max_depth - local)
        if prefix[first + width] - prefix[first] <= capacity or local == max_depth:
            done.append((first, local))
            continue
        if local == depth:  # the directory doubles
            depth += 1
        todo += [(first, local + 1), (first + width // 2, local + 1)]
    buckets = []
    for first, local in sorted(done):
        buckets += [(first, local)] * (1 << (depth - local))
    return depth, buckets


def dealt(buckets: list[tuple[int, int]], load: dict[int, int], owners: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int]]:
    """For each directory entry its bucket's number and owner.

    ``load`` is each slot's number of rows.  An owner has neighbouring buckets, of
    which the rows' middle falls into its share of all rows.
    """
    prefix = [0]
    for slot in range(1 << max_depth):
        prefix.append(prefix[-1] + load.get(slot, 0))
    number = {}
    for first, local in sorted(set(buckets)):
        middle = (prefix[first] + prefix[first + (1 << (max_depth - local))]) / 2
        number[first, local] = (len(number), min(owners - 1, int(middle * owners / max(prefix[-1], 1))))
    return [number[b] for b in buckets]


@dataclass(frozen=True)
class Index:
    """The files of an index in the shared folder and the depth of its directory."""

    spark: SparkSession
    path: str
    depth: int

    @property
    def entries(self) -> DataFrame:
        """owner, bucket, key, digest, keep_id, keep_n, keep_mark, group_size: a row for each group of equal texts."""
        return self.spark.read.parquet(f"{self.path}/entries")

    def located(self, rows: DataFrame) -> DataFrame:
        """Rows with a ``key``, with the bucket and owner that the directory has for it.

        The directory has at most ``2 ** MAX_DEPTH`` rows, hence the broadcast.
        """
        directory = F.broadcast(self.spark.read.parquet(f"{self.path}/directory"))
        return rows.join(directory, slot_of(F.col("key"), self.depth) == F.col("entry")).drop("entry")


def light_rows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, key, digest of each row, computed once: the directory and the look-ups need them."""
    rows = documents.select(F.col(id_col).alias("id"), F.length(text_or_empty(text_col)).alias("n"), normalised(text_col).alias("norm"))
    return cut(rows.select("id", "n", key_of(F.col("norm")).alias("key"), F.sha2(F.col("norm").cast("binary"), 256).alias("digest")))


def _mark(id_col: str, text_col: str) -> Column:
    """What tells the row that stays from others of its id: two hashes of the text as it is."""
    text = text_or_empty(text_col)
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def build_index(documents: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, owners: int | None = None) -> Index:
    """Build the index of ``documents``, whose keys are the column ``key`` of ``keys``.

    There are as many owners as shuffle partitions, unless their number is given.
    """
    spark = documents.sparkSession
    owners = owners or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chains = cut(keys.groupBy("key").agg(F.count("*").alias("copies")))
    limit = max(keys.count() * HOT_SHARE, HOT_LEAST)
    hot = F.col("copies") > limit
    slots = chains.groupBy(slot_of(F.col("key")).alias("slot")).agg(F.count("*").alias("keys"), F.sum(F.when(~hot, F.col("copies")).otherwise(0)).alias("rows")).collect()
    total = sum(r["keys"] for r in slots)
    depth, buckets = build_directory({r["slot"]: r["keys"] for r in slots}, capacity or min(MOST, max(1, total // 1024)))
    if depth == 0:  # both entries of a one-bit directory lead to the one bucket
        depth, buckets = 1, buckets * 2
    path = f"{shared_dir(spark)}/exact-index-{uuid.uuid4().hex}"
    entries = list(enumerate(dealt(buckets, {r["slot"]: r["rows"] for r in slots}, owners)))
    schema = T.StructType([T.StructField(n, T.IntegerType(), False) for n in ("entry", "bucket", "owner")])
    spark.createDataFrame([(e, b, o) for e, (b, o) in entries], schema).coalesce(1).write.parquet(f"{path}/directory")
    index = Index(spark, path, depth)

    norm = normalised(text_col)
    rows = documents.select(F.length(text_or_empty(text_col)).alias("n"), norm.alias("norm"), _mark(id_col, text_col).alias("mark")).withColumn("key", key_of(F.col("norm")))
    # fewer than 1 / HOT_SHARE keys, hence the broadcast
    rows = index.located(rows).join(F.broadcast(chains.filter(hot).select("key", F.lit(True).alias("hot"))), "key", "left")
    anyone = F.pmod(F.xxhash64("mark", F.spark_partition_id()), F.lit(owners)).cast("int")
    stays = F.min(F.struct((-F.col("n")).alias("inv"), F.col("mark.id").isNull().alias("no_id"), "mark")).alias("stays")
    held = rows.withColumn("task", F.when(F.col("hot"), anyone).otherwise(F.col("owner"))).repartitionById(owners, F.col("task"))
    # equal texts are told by their bytes here, at the owner
    held = held.groupBy("task", "owner", "bucket", "key", "norm").agg(F.count("*").alias("size"), stays)
    held = held.select("owner", "bucket", "key", F.sha2(F.col("norm").cast("binary"), 256).alias("digest"), "size", "stays").repartitionById(owners, F.col("owner"))
    whole = held.groupBy("owner", "bucket", "key", "digest").agg(F.sum("size").alias("group_size"), F.min("stays").alias("stays"))
    whole = whole.select("owner", "bucket", "key", "digest", F.col("stays.mark.id").alias("keep_id"), (-F.col("stays.inv")).alias("keep_n"), F.col("stays.mark").alias("keep_mark"), "group_size")
    whole.sortWithinPartitions("owner", "bucket", "key", "digest").write.parquet(f"{path}/entries")
    return index


def assign(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = light_rows(documents, id_col, text_col)
    index = build_index(documents, rows.select("key"), id_col, text_col, **options)
    entries = index.entries.drop("keep_mark").withColumn("__n", F.col("group_size"))
    found = lookup(index.located(rows), entries, ["owner", "bucket", "key", "digest"], "__n", rows.count(), ["id", F.spark_partition_id()])
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def survivors(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns; one row for each group of equal texts.

    The join's keys hold the id, so that copies of one text spread over all tasks.
    """
    keys = cut(documents.select(key_of(normalised(text_col)).alias("key")))
    stay = build_index(documents, keys, id_col, text_col, **options).entries.select(F.col("keep_mark").alias("__stay")).distinct()
    kept = documents.withColumn("__mark", _mark(id_col, text_col)).join(stay, F.col("__mark").eqNullSafe(F.col("__stay")), "left_semi")
    return kept.dropDuplicates(["__mark"]).drop("__mark")
