"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target number of words: its weight's share of all words, at
most ``max_epochs`` times what it has, the excess shared among the others by
weight (water-filling, in closed form over the sources).  A target is made of
complete epochs of the source and a fraction of one more.  The fraction is an
Efraimidis-Spirakis sample: documents get exponential keys ``-ln(u) / quality``,
are taken in the order of their keys, and sizes are prefix-summed up to the
remainder; the document that crosses it is taken if that comes nearer.

Prefix sums do not sort a source in one task.  Keys fall into ranges of their
logarithm; sums of ranges are added up per source (at most 16 * ``buckets``
rows each) and only rows within one range are sorted together.  Rows that are alike
in all that decides are one row with a number there, so that many repeats of one
row, as with a null id, are not sorted either.

u comes from MD5 of the seed and the document's id, so reruns agree.

Defined results: null text has size 0; a null source is a source of its own,
after all others; a null id hashes as empty text; rows that repeat an id tie and
are ordered by size; an empty table gives no rows.  The sources' totals (one row
per source, at most ``max_sources``, else an error) are the one thing gathered.
Other columns, whatever their names, only travel with their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, cut, lookup, text_or_empty

WEIGHTS = (1, 2, 3)


def quality(text_col: str = "text") -> Column:
    """A document's weight in the sample: 0.1 to 1, by its share of ASCII letters and spaces."""
    text = text_or_empty(text_col)
    plain = F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z ]++", ""))  # few and long matches
    return F.lit(0.1) + F.lit(0.9) * plain / F.greatest(F.length(text), F.lit(1))


def uniform(id_col: str, seed: str) -> Column:
    """In (0, 1), from the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: list[int], weights: list[float], max_epochs: float = 3) -> list[float]:
    """Target words of each source.

    Sources reach their caps in the order of size / weight.  In that order the level
    (what is left to share over the weight left) only rises, so the capped ones come
    first, and the first one below its cap ends them.
    """
    order = sorted(range(len(sizes)), key=lambda k: sizes[k] / weights[k])
    rest, weight = float(sum(sizes)), float(sum(weights))
    out = [0.0] * len(sizes)
    while order and max_epochs * sizes[order[0]] <= rest * weights[order[0]] / weight:
        i = order.pop(0)
        out[i] = float(max_epochs * sizes[i])
        rest -= out[i]
        weight -= weights[i]
    for i in order:
        out[i] = rest * weights[i] / weight
    return out


def key_range(key: Column, buckets: int) -> Column:
    """The range of a key, in the keys' order: ``buckets`` / 4 to a doubling.

    A quality only shifts the logarithm of its keys, so whatever the qualities of a
    source, a range expects at most about a ``buckets``-th of its rows.
    """
    return F.coalesce(F.floor(F.log2(key) * (buckets / 4)), F.lit(-64 * buckets)).cast("int")


def _mark(documents: DataFrame) -> list[Column]:
    """128 bits of a whole row, nulls told from values."""
    kinds = documents.schema.fields
    values = [F.array_sort(F.map_entries(F.col(f"`{f.name}`"))) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in kinds]
    each = [x for v in values for x in (v, v.isNull())]
    return [F.xxhash64(*each).alias("m1"), F.xxhash64(F.lit(1), *each).alias("m2")]


def mix(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = 3,
    seed: str = "mix",
    buckets: int = 4096,
    max_sources: int = 100_000,
) -> DataFrame:
    """A row for each row: doc_id, source, size, source_size, target, taken, times.

    The weights go to the sources in code-point order of their names, repeating.
    ``times`` is how often the mix takes the document.
    """
    return _mix(documents, id_col, text_col, source_col, weights, max_epochs, seed, buckets, max_sources, []).select("doc_id", "source", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times")


def _mix(documents: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], max_epochs: int, seed: str, buckets: int, max_sources: int, marks: list[Column]) -> DataFrame:
    spark = documents.sparkSession
    kind = documents.schema[source_col].dataType
    rows = documents.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        (-F.log(uniform(id_col, seed)) / quality(text_col)).alias("key"),
        *marks,
    )
    names = rows.columns[4:]
    rows = rows.withColumn("part", key_range(F.col("key"), buckets))
    rows = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("alike")))
    parts = cut(rows.groupBy("source", "part").agg(F.sum(F.col("size") * F.col("alike")).alias("words")))
    found = parts.groupBy("source").agg(F.sum("words").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"over {max_sources} sources")
    found = sorted(((r["source"], r["n"]) for r in found), key=lambda x: (x[0] is None, str(x[0])))
    goal = targets([n for _, n in found], [weights[i % len(weights)] for i in range(len(found))], max_epochs)
    schema = T.StructType([T.StructField("s", kind), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("epochs", T.LongType()), T.StructField("remainder", T.DoubleType())])
    plan = []
    for (source, n), target in zip(found, goal, strict=True):
        epochs = int(target / n) if n else 0
        plan.append((source, n, target, epochs, target - epochs * n))
    # parts has at most 16 * `buckets` rows a source, plan one: both proven bounds
    before = F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0)))
    parts = parts.join(F.broadcast(spark.createDataFrame(plan, schema)), F.col("source").eqNullSafe(F.col("s"))).drop("s", "words")
    parts = parts.withColumnsRenamed({"source": "s", "part": "p"})
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    upto = F.sum(F.col("size") * F.col("alike")).over(Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", *names).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("first", F.col("before") + upto - F.col("size") * F.col("alike"))
    rows = rows.withColumn("upto", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike")))).withColumn("upto", F.col("first") + F.col("size") * F.col("upto"))
    lack = F.col("remainder") - (F.col("upto") - F.col("size"))
    chosen = (F.col("upto") <= F.col("remainder")) | ((lack > 0) & (F.col("upto") - F.col("remainder") < lack))
    return rows.withColumn("times", F.col("epochs") + F.when(chosen & (F.col("size") > 0), 1).otherwise(0))


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3, seed: str = "mix", buckets: int = 4096, max_sources: int = 100_000) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, with all its columns.

    Rows meet their number by 128 bits of the whole row, so rows that share an id
    are told apart.  Of rows that repeat each other in every column the mix may take
    some once more than others; as they are the same, one of them stands for all.
    """
    taken = _mix(documents, id_col, text_col, source_col, weights, max_epochs, seed, buckets, max_sources, _mark(documents))
    taken = cut(taken.groupBy("m1", "m2").agg(F.count("*").alias("alike"), F.min("times").alias("least"), F.max("times").alias("most"), F.sum("times").alias("all")).filter("most > 0"))
    m1, m2 = _mark(documents)
    marked = documents.withColumns({"__m1": m1, "__m2": m2})
    table = taken.select(F.col("m1").alias("__m1"), F.col("m2").alias("__m2"), "alike", "least", "most", "all")

    def copies(rows: DataFrame, times: str) -> DataFrame:
        return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*(F.col(f"`{c}`") for c in documents.columns))

    even = table.filter("least = most").select("__m1", "__m2", F.col("most").alias("__times"), F.col("alike").alias("__alike"))
    out = copies(lookup(marked, even, ["__m1", "__m2"], "__alike", documents.count(), ["__m1", F.spark_partition_id()]), "__times")
    # the mix cuts each source at one place, so there is one such row a source at most
    uneven = table.filter("least < most").select("__m1", "__m2", F.col("all").alias("__times"))
    if uneven.isEmpty():
        return out
    return out.unionAll(copies(marked.join(F.broadcast(uneven), ["__m1", "__m2"]).dropDuplicates(["__m1", "__m2"]), "__times"))
