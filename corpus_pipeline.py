"""A training corpus from ``documents``: five stages, each written as Parquet and read again as the next
one's input. All but the last return the columns of ``documents``.

quality   documents that the classifier rejects go
near-dup  one document of each class of near-duplicate texts stays
secrets   secrets are masked; no document goes
mixing    sources are brought to their target weights; a document may appear up to three times
packing   segments of at most 2048 tokens, in length buckets and batches of a token budget

A stage is to be written before the next one is called, as ``run`` does: each call deletes the intermediate tables
of the stage called before it in the same application, and no others.

An empty input passes through every stage; nulls, repeated rows and extra columns are handled as each operator says.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from transitlake.llm import buckets, minhash, mixing, quality, secrets
from transitlake.llm.common import materialize, on_workers, table
from transitlake.session import collected, drop

_LEFT: dict[str, list[str]] = {}  # by application: the tables of the stage called last


def _stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(fn)
    def called(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _LEFT.pop(spark.sparkContext.applicationId, []))
        on_workers(spark)
        with collected() as made:
            out = fn(spark, docs, sf_dir)
        _LEFT[spark.sparkContext.applicationId] = made
        return out

    return called


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


@_stage
def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


@_stage
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return buckets.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("near-dup", near_dup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# A trained classifier and weighted samples are not SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again. What a stage made or
    read is deleted when its output is written; the last output stays for the frame that is returned."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        with collected() as written:
            docs = materialize(out, f"stage-{name}")
        drop(spark, _LEFT.pop(spark.sparkContext.applicationId, []) + before)
        before = written
    return docs
