"""Pluggable sources: functions that give tables, by kind and name; answers without a model; loaders."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Backend = Callable[..., DataFrame]
_KNOWN: dict[str, dict[str, Backend]] = {}


def register(kind: str, name: str) -> Callable[[Backend], Backend]:
    """Adds a function that gives a table, such as predicted poses or verdicts, under a name of its kind."""

    def add(f: Backend) -> Backend:
        if name in _KNOWN.setdefault(kind, {}):
            raise ValueError(f"{kind} backend {name} is there already")
        _KNOWN[kind][name] = f
        return f

    return add


def names(kind: str) -> list[str]:
    return sorted(_KNOWN.get(kind, {}))


def table(kind: str, name: str, *args: Any, **options: Any) -> DataFrame:
    """The table that a backend gives; an unknown name is an error that lists the known ones."""
    known = _KNOWN.get(kind, {})
    if name not in known:
        raise ValueError(f"unknown {kind} backend {name!r}; known: {', '.join(sorted(known)) or 'none'}")
    return known[name](*args, **options)


@register("verdicts", "dry_run")
def dry_run(pairs: DataFrame) -> DataFrame:
    """Answers without a model for pairs (step_id, gt_idx, pred_idx): nothing is said about any of them."""
    return pairs.select("step_id", "gt_idx", "pred_idx", F.lit(None).cast("boolean").alias("same"), F.lit(None).cast("double").alias("confidence"), F.lit("dry_run").alias("note"))


@register("verdicts", "table")
def from_table(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """Recorded answers (step_id, gt_idx, pred_idx, same, confidence) for the pairs they are about."""
    keys = ["step_id", "gt_idx", "pred_idx"]
    return pairs.select(*keys).join(answers.select(*keys, "same", "confidence"), keys, "left").withColumn("note", F.when(F.col("same").isNull(), "unanswered"))


@register("poses", "table")
def recorded_poses(steps: DataFrame, poses: DataFrame) -> DataFrame:
    """Recorded poses for steps (id)."""
    return steps.select("id").join(poses, "id")


def loader(module: str, member: str | None = None) -> Any:
    """A module or its member, loaded when it is wanted; one that is not installed is a plain error."""
    try:
        found = import_module(module)
    except ImportError as e:
        raise ValueError(f"{module} is not installed") from e
    return found if member is None else getattr(found, member)
