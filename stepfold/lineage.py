"""Cutting lineage in iterative jobs, so that plans stay small and lost executors cost one round."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the folder that ``spark.checkpoint.dir`` names and go on from there.

    Where that is unset, a local session (driver and executors are one process) gets a
    temporary folder; a cluster without the setting is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not where:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="stepfold-")
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)
