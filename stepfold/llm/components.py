"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup


def _least(edges: DataFrame) -> DataFrame:
    """u, m, n: each node with edges (u, v), the least of its v and their number."""
    return cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("u", "m"))
    # the centre of a large star has its edges in many tasks
    return lookup(both.filter("v > u"), least, ["u"], "n", 2 * total, ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = _least(down)
    moved = lookup(down, least, ["u"], "n", total, ["v"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) to ``(u, v)`` where v is the least node of u's component.

    The least node itself has no row.  Each round is two keyed aggregations and
    joins over the edges; nothing is gathered on the driver but two numbers.
    """
    edges = edges.filter("u <> v")
    now = cut(_small_star(edges, max(edges.count(), 1)))
    seen = None
    for _ in range(max_rounds):
        total, sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (total, sign) == seen:
            return now
        seen = (total, sign)
        now = cut(_small_star(cut(_large_star(now, max(total, 1))), max(total, 1)))
    raise RuntimeError("components did not settle")
