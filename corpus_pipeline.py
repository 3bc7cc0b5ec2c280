"""Corpus pipeline: toxicity, quality rules, near duplicates, secrets, packing.

Each stage gets the documents its predecessor kept, whole, and returns the columns of documents (the last one: pieces of packed
sequences). run() writes each stage's rows as Parquet into the shared folder and reads them again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import jaccard_join, packing, quality_rules, secret_scan, toxicity
from brindle.llm.common import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents predicted toxic go. The model learns from the training fold of all documents of this stage."""
    return toxicity.keep(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that fail the base rules or lie outside the compression bands go."""
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of documents linked at a Jaccard similarity of 0.8 on five-word shingles one stays."""
    return jaccard_join.keep_one(docs, width=5, num=4, den=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: every secret found is replaced by a mark."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: sequences of at most 1024 tokens; a row is a piece of a document, with its ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_low_quality), ("near_duplicates", drop_near_duplicates), ("secret_scans", redact_secrets), ("packing", pack_sequences)]

#: Training a classifier, zstandard ratios and byte-pair encoding are not SQL; tests/llm/ compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
