"""Data contracts: declarative rules, violations and their precedence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``ok`` must hold; NULL counts as broken.  A smaller priority is reported first."""

    name: str
    ok: Column
    priority: int = 0


def violations(df: DataFrame, key: list[str], rules: list[Rule]) -> DataFrame:
    """One row per broken rule: the key columns, rule, priority.  One pass, no shuffle."""
    broken = [F.when(~F.coalesce(r.ok, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.priority).alias("priority"))) for r in rules]
    return df.select(*key, F.explode(F.array_compact(F.array(*broken))).alias("v")).select(*key, "v.rule", "v.priority")


def quarantine(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the names of those they break."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(r.ok, F.lit(False)), F.lit(r.name)) for r in rules)))
    marked = df.withColumn("broken", broken)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)


def first_violation(found: DataFrame, order: list[str]) -> DataFrame:
    """The violation that a fail-fast check would report: least (priority, order..., rule)."""
    return found.agg(F.min(F.struct("priority", *order, "rule")).alias("first")).select("first.*")


def assert_clean(found: DataFrame, order: list[str]) -> None:
    row = first_violation(found, order).first()
    if row is not None and row["rule"] is not None:
        raise ValueError(f"{row['rule']}: {row.asDict()}")


def duplicates(df: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Keys that occur more than once, with their number and first place."""
    first = [F.min(order).alias("first_at")] if order else []
    return df.groupBy(*key).agg(F.count("*").alias("n"), *first).filter("n > 1")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side: one full join instead of two anti joins."""
    a, b = left.select(F.col(key).alias("a")).distinct(), right.select(F.col(key).alias("b")).distinct()
    j = a.join(b, F.col("a") == F.col("b"), "full").filter("a IS NULL OR b IS NULL")
    return j.select(F.coalesce("a", "b").alias(key), F.when(F.col("b").isNull(), "left").otherwise("right").alias("side"))


def attribute_diff(left: DataFrame, right: DataFrame, key: str, columns: list[str], relative: float = 0.0, absolute: float = 0.0) -> DataFrame:
    """Rows of equal keys that differ, and in which columns; numbers may differ by a tolerance."""
    kinds = dict(left.dtypes)

    def same(c):
        l, r = F.col(f"l.{c}"), F.col(f"r.{c}")
        if (relative or absolute) and kinds[c] in ("double", "float"):
            near = F.abs(l - r) <= F.greatest(F.lit(absolute), F.greatest(F.abs(l), F.abs(r)) * relative)
            return F.coalesce(near, l.isNull() & r.isNull())
        return l.eqNullSafe(r)

    j = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"))
    diff = F.array_compact(F.array(*(F.when(~same(c), F.lit(c)) for c in columns)))
    return j.select(F.col(f"l.{key}").alias(key), diff.alias("columns")).filter(F.size("columns") > 0)
