"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from transitlake.llm import (buckets, embed_dedup, exact_dedup, filter_audit, fim, minhash, mixing, pii, preference, quality, secrets,
                            tokens, topk)
from transitlake.llm.common import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.neighbours(table(spark, sf_dir, "conversations"))


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.pairs(table(spark, sf_dir, "conversations"))


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.packed(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))[0]


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(table(spark, sf_dir, "documents"), with_text=False)


def secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.ledger_increments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_minhash_near_dedup, op2_token_counts, op3_preference_format, op4_length_buckets, op5_embedding_near_dedup,
             op6_pii, op7_top_k, op8_quality, op9_secret_scan, op10_mixing, op11_filter_audit, op12_exact_dedup, op13_fill_in_middle)
    return {f.__name__: f for f in named} | {
        "preference_pairs": preference_pairs, "secret_ledger": secret_ledger, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_preference_format": preference.ORACLE_SQL, "preference_pairs": preference.PAIRS_SQL, "op5_embedding_near_dedup": embed_dedup.ORACLE_SQL,
            "secret_ledger": secrets.LEDGER_SQL, "op7_top_k": topk.ORACLE_SQL, "op11_filter_audit": filter_audit.ORACLE_SQL,
            "op12_exact_dedup": exact_dedup.ORACLE_SQL, "op13_fill_in_middle": fim.ORACLE_SQL}
