"""The document pipeline: quality rules, near-duplicates, benchmark passages, secrets, tokens.

Every stage works on all that the one before it kept; a stage's result is written below ``spark.checkpoint.dir`` and read
again.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight.llm import bpe, credentials, decontamination, line_rules, near_duplicates
from quarterlight.llm.common import read
from quarterlight.llm.queries import WORD_BPE
from quarterlight.session import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines."""
    kept = line_rules.judge(docs).filter("kept").withColumn("text", F.col("clean_text"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8."""
    return near_duplicates.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly are such passages go."""
    return decontamination.remove(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and the identifiers linked to them are masked."""
    masked = credentials.masked(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, digests of the ids and of the text they decode to."""
    return bpe.digests(docs, WORD_BPE)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("tokens", tokens),
]

#: Connected groups and byte-pair merges can't be said in SQL; the tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
