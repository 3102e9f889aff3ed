"""Queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import exact_dedup, fingerprints, packing, secrets, sentencepiece_ops, sharding, simhash, suffix_dedup, token_output, toxicity
from marginalia.llm.common import documents


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), 40)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_ops.encode_documents(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_exact_dedup, op3_fingerprints, op4_suffix_dedup, op5_simhash, op6_secrets, op7_packing, op8_sentencepiece, op9_toxicity, op10_token_output)}

ORACLES = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha AS text_sha256
        FROM (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents) WINDOW w AS (PARTITION BY sha)
    """,
}
