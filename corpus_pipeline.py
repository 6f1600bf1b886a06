"""Corpus pipeline: toxicity filter, near-dedup, secret redaction, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet into the shared folder and hands the reread table on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import shared_table, shield, table
from graphloom.llm.mixing import mix_rows
from graphloom.llm.near_copies import dedup
from graphloom.llm.packing import pack
from graphloom.llm.secret_scan import redact
from graphloom.llm.toxicity import fit, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose noisy-or score is 0.5 or more; null and empty texts stay."""
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    docs, restored = shield(docs, "text")
    return score_toxicity(docs, model, docs.columns).where("score < 0.5 or text is null").select(*restored)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share 0.8 or more of their five-word shingles with a kept one of smaller id."""
    return dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every document stays."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("simhash_dedup", simhash_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Model fitting, hashing of shingles and packing can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
