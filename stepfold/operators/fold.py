"""Hierarchical folds: steps to cases to subtypes to a total, each an unweighted mean of means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import action_score, mean_plus_worst, object_components, present
from .order import radix_quantiles

PILLARS = ("f1", "spatial", "integrity")


def with_action_score(steps: DataFrame) -> DataFrame:
    return steps.withColumn("score", action_score(F.col("action_sign_correct"), F.col("action_expected"), F.col("action_abs_err"), F.col("action_unit")))


def case_scores(steps: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """One row per case; extra leading keys (such as a numeric case key) keep a partitioning that is there."""
    return with_action_score(steps).groupBy(*keys, "subtype").agg(F.avg("score").alias("case_score"), F.count("*").alias("num_steps"))


def macro_score(steps: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """One row: the three subtypes' scores, their counts and the total.

    A subtype without cases makes the total null, which ``assert_complete`` reports.
    """
    kinds = case_scores(steps, keys).groupBy("subtype").agg(F.avg("case_score").alias("s"), F.count("*").alias("n"), F.sum("num_steps").alias("k"))
    pick = [x for kind in ("atomic", "chain", "cycle") for x in (F.max(F.when(F.col("subtype") == kind, F.col("s"))).alias(f"cmg_{kind}"), F.coalesce(F.max(F.when(F.col("subtype") == kind, F.col("n"))), F.lit(0)).alias(f"num_{kind}_cases"))]
    one = kinds.agg(*pick, F.sum("n").alias("num_valid_cases"), F.sum("k").alias("num_valid_steps"))
    return one.withColumn("cmg", (F.col("cmg_atomic") + F.col("cmg_chain") + F.col("cmg_cycle")) / 3)


def assert_complete(total: DataFrame, column: str) -> DataFrame:
    return total.withColumn(column, F.when(F.col(column).isNotNull(), F.col(column)).otherwise(F.raise_error(F.lit(f"missing subtype for {column}"))))


def mask_invalid_cases(steps: DataFrame, key: str = "case_id") -> DataFrame:
    """Drop every step of a case in which any step has no object."""
    bad = F.max((F.col("num_gt_objects") <= 0).cast("int")).over(Window.partitionBy(key))
    return steps.withColumn("_bad", bad).filter("_bad = 0").drop("_bad")


def invalid_cases(steps: DataFrame, key: str = "case_id") -> DataFrame:
    return steps.groupBy(key).agg(F.count_if(F.col("num_gt_objects") <= 0).alias("bad_steps")).filter("bad_steps > 0")


def with_components(steps: DataFrame) -> DataFrame:
    """Components of each step; recall and what rests on it are null where a step has no object."""
    g = F.when(F.col("num_gt_objects") > 0, F.col("num_gt_objects"))
    return steps.withColumns(object_components(g, *(F.col(x) for x in ("num_pred_all", "num_matched", "center_error_norm", "object_integrity", "relative_topology"))))


def _case_aggregates() -> list:
    """Mean plus worst of each pillar, and whether any step has no object (1 or 0)."""
    return [*(mean_plus_worst(p).alias(p) for p in PILLARS), F.max((F.col("num_gt_objects") <= 0).cast("int")).alias("_bad")]


def case_pillars(steps: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Mean plus worst of each pillar over the steps of each valid case.

    A case is valid if all its steps have objects.  As a case has one subtype, the
    fold itself finds that out: no window and no second shuffle is needed.
    """
    return with_components(steps).groupBy(*keys, "subtype").agg(*_case_aggregates()).filter("_bad = 0").drop("_bad")


def pillar_fold(steps: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """One row per subtype with its pillars and score, over valid cases."""
    kinds = case_pillars(steps, keys).groupBy("subtype").agg(F.count("*").alias("num_cases"), *(F.avg(p).alias(p) for p in PILLARS))
    return kinds.withColumn("ssp", (F.col("f1") + F.col("spatial") + F.col("integrity")) / 3)


def overall(steps: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """One row (cmg, ssp) of steps that carry both kinds of records: one read and one fold over cases for both."""
    cases = with_components(with_action_score(steps)).groupBy(*keys, "subtype").agg(F.avg("score").alias("s"), *_case_aggregates())
    kinds = cases.groupBy("subtype").agg(F.avg("s").alias("s"), *(F.avg(F.when(F.col("_bad") == 0, F.col(p))).alias(p) for p in PILLARS))
    picked = [F.max(F.when(F.col("subtype") == k, F.col("s"))).alias(k) for k in ("atomic", "chain", "cycle")]
    one = kinds.agg(*picked, F.avg((F.col("f1") + F.col("spatial") + F.col("integrity")) / 3).alias("ssp"))
    return one.select(((F.col("atomic") + F.col("chain") + F.col("cycle")) / 3).alias("cmg"), "ssp")


#: Tables of up to so many bytes on disk may have a group's different values in one task's buffer.
HELD_BYTES = 1 << 28


def is_small(spark: SparkSession, *paths: str, most: int = HELD_BYTES) -> bool:
    """Whether the files of some tables are at most ``most`` bytes together; no plan is made and no job run."""
    total = 0
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        total += where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return total <= most


def quantiles(df: DataFrame, columns: list[str], p: float, by: list[str] | None = None, direct: bool = False) -> DataFrame:
    """(by..., column, quantile): by radix selection, or (``direct``, for small tables) in one aggregation; the rows are the same."""
    if not direct:
        return radix_quantiles(df, columns, [p], by).drop("p")
    by = by or []
    one = df.groupBy(*by).agg(*(F.percentile(present(F.col(c).cast("double")), F.lit(p)).alias(c) for c in columns))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("quantile")) for c in columns))).alias("q")
    return one.select(*by, each).select(*by, "q.column", "q.quantile").filter("quantile IS NOT NULL")


def summary(df: DataFrame, columns: list[str], by: list[str] | None = None, direct: bool = False) -> DataFrame:
    """mean, median, least, largest and count of each column, skipping NULL and NaN; ``direct`` as for ``quantiles``."""
    by = by or []
    aggs = []
    for c in columns:
        x = present(F.col(c))
        aggs += [F.avg(x).alias(f"{c}_mean"), *([F.median(x).alias(f"{c}_median")] if direct else []), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), F.count(x).alias(f"{c}_count")]
    one = df.groupBy(*by).agg(*aggs)
    if direct:
        return one
    keys = [f"_k{n}" for n in range(len(by))]
    medians = quantiles(df, columns, 0.5, by).groupBy(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)))
    medians = medians.agg(*(F.max(F.when(F.col("column") == c, F.col("quantile"))).alias(f"{c}_median") for c in columns))
    on = F.lit(True)
    for b, k in zip(by, keys, strict=True):
        on = on & F.col(b).eqNullSafe(F.col(k))
    # without groups both sides are one row
    return one.join(medians if by else F.broadcast(medians), on, "left").drop(*keys)
