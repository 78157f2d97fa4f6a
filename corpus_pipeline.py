"""From raw documents to packed training sequences, in five stages over the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs``; its result is written as Parquet and read again as the
next one's input. All but the last return the columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacantia.llm import best_fit, near_dups, quality_rules, secret_scan, toxicity
from vacantia.llm.shared import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the threshold table keep."""
    return quality_rules.passing(docs)


def civility(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the labels of the kept documents teach."""
    return toxicity.civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five-word shingles, similarity of 0.8 or more)."""
    return near_dups.one_of_each(docs, width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by the name of its kind, and n_chars of the new text."""
    return secret_scan.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all documents in sequences of at most 1024 tokens."""
    import public_tokenizers as P

    return best_fit.pack(docs, P.path("byte_bpe_50k.json"), "byte_level", end_id=2, capacity=1024)


STAGES = [("quality", quality), ("toxicity", civility), ("near_duplicates", deduplication), ("secrets", secrets), ("packing", packing)]

#: A learned score, signatures and tokens are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
