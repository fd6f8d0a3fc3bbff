"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, tokenisation.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns what it keeps with the columns of ``documents`` (the last one: token
digests).  Stages are written as Parquet in the shared folder and read again; what a
stage has written goes once the next one has written its own.

Defined results: null and empty texts have no language and go in the first stage, as
do documents that no language explains for the most part; of equal texts, and of near
copies, one document stays, and of rows that repeat each other one; rows without an id
are documents, all of one id; the mix repeats whole rows, whatever their ids; extra
columns travel along, whatever their names; an empty table gives an empty one.

The rows depend on hash sampling, EM and XXH64, which DuckDB's SQL lacks, so
``ORACLE_SQL`` is None; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.llm import bpe, entries, exact_dedup, langid, mixing, simhash
from stepfold.llm.common import drop_files, shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the labels know; ``und`` and even mixtures go."""
    return langid.accepted(docs, langid.fit(docs.filter(~langid.held_out())))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one of least doc_id.

    Rows without an id stay if their component has no id at all.
    """
    stay = simhash.near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stay")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__stay")), "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of token digests for each document of the mix."""
    return bpe.digests(docs, public_tokenizers.path(entries.BPE_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing", mix),
    ("byte_bpe", tokenise),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, last = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            drop_files(spark, last)
        last = path
    return docs
