"""Structured Streaming over arriving predictions: an extension, with batch parity.

Predictions arrive as JSON Lines files.  They are checked by declarative rules, as in
batch, deduplicated on (case_id, step_id) within a watermark, and a case is emitted
once all its expected steps have arrived.  A case's state goes when the watermark has
passed its last step by ``keep``, so states don't pile up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.contract import prediction_rules
from ..operators.rules import Rule, quarantine

SCHEMA = "case_id string, step_id int, score double, arrived timestamp"


def arriving(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def step_rules() -> list[Rule]:
    """What an arriving step must keep; the batch contract's rules on the same fields."""
    batch = {r.name: r for r in prediction_rules("")}
    return [batch["case_id"], batch["step_id"], Rule("score", F.col("score").between(0, 1)), Rule("arrived", F.col("arrived").isNotNull())]


def distinct_steps(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Valid predictions, the first of each (case_id, step_id)."""
    good, _ = quarantine(stream, step_rules())
    return good.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["case_id", "step_id"])


def windowed_counts(stream: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("arrived", delay).groupBy(F.window("arrived", width)).agg(F.count("*").alias("steps"), F.avg("score").alias("mean_score"))


def complete_cases(stream: DataFrame, expected: int, delay: str = "1 hour", keep: str = "1 hour") -> DataFrame:
    """(case_id, steps, case_score), once for each case, when steps 1 to ``expected`` are all there.

    A case is remembered until the watermark is ``keep`` past its last step; a repeat
    that is later still starts it anew.
    """
    wait = int(pd.Timedelta(keep).total_seconds() * 1000)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, total, done, last = state.get if state.exists else ([], 0.0, False, 0)
        seen = list(seen)
        for part in parts:
            for step, score, arrived in part[["step_id", "score", "arrived"]].itertuples(index=False, name=None):
                last = max(last, int(arrived.timestamp() * 1000))
                if step <= expected and step not in seen:
                    seen.append(int(step))
                    total += float(score)
        ready = len(seen) == expected and not done
        state.update((seen, total, done or ready, last))
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        if ready:
            yield pd.DataFrame({"case_id": [key[0]], "steps": [expected], "case_score": [total / expected]})

    good, _ = quarantine(stream, step_rules())
    return good.withWatermark("arrived", delay).groupBy("case_id").applyInPandasWithState(run, "case_id string, steps int, case_score double", "seen array<int>, total double, done boolean, last bigint", "append", GroupStateTimeout.EventTimeTimeout)
