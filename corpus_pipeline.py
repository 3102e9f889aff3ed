"""Corpus pipeline: toxic documents go, copies go, near copies go, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Null texts are empty documents; rows that share a doc_id and a text are copies. An empty table passes through. Extra columns
of any name pass the first four stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import exact_dedup, packing, secrets, simhash, toxicity
from marginalia.llm.common import stash, unstash

#: The similarity stage works on shingles of five words.
SHINGLE = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models, learnt from `labels`, reject are dropped."""
    return toxicity.ordinary(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity of five-word shingles 0.8 or more) the row with the smallest doc_id stays."""
    return simhash.keep_distinct(docs, SHINGLE)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; every document stays."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences by best fit."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("secrets", mask_secrets), ("packing", pack)]

#: The models of stages 1, 3, 4 and 5 are out of SQL's reach; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir), f"stage-{name}")
        unstash(before)  # the next stage reads what this one wrote
    return STAGES[-1][1](spark, docs, sf_dir)
