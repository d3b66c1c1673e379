"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight.llm import (
    bpe, credentials, cross_entropy, decontamination, drift_clusters, line_field, line_rules, main_text, near_duplicates, packing, personal_data,
    phrases, toxicity,
)
from quarterlight.llm.common import read

#: The default vocabulary of op8 and of the pipeline; operators take its path as a parameter.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: That of op11.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


@query("op1_credential_links")
def credential_links(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.report(credentials.scan(read(spark, sf, "documents")))


@query("op7_line_rules")
def line_first_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = line_rules.judge(read(spark, sf, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    )


def _labels(spark: SparkSession, sf: str, column: str, modulus: int, held: int) -> DataFrame:
    """The labels that may be learned from: those whose remainder is not the held-out one."""
    return read(spark, sf, "labels").filter(line_field.remainder(F.col("doc_id"), modulus) != held).select("doc_id", F.col(column).alias("label"))


@query("op2_line_field")
def line_field_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    field = line_field.learn(docs, _labels(spark, sf, "quality", 5, 0))
    return line_field.verdicts(line_field.score(docs, field), 5, 0)


@query("op3_near_duplicates")
def near_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf, "documents"), width=3, similarity=0.85)


@query("op4_subword_toxicity")
def subword_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    model = toxicity.learn(docs, _labels(spark, sf, "toxic", 4, 2))
    return line_field.verdicts(toxicity.score(docs, model), 4, 2)


@query("op5_personal_data")
def personal_data_spans(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data.scan(read(spark, sf, "documents"))


@query("op6_main_text")
def tag_path_text(spark: SparkSession, sf: str) -> DataFrame:
    return main_text.extract(read(spark, sf, "pages"))


@query("op8_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(read(spark, sf, "documents"), WORD_BPE)


@query("op9_cross_entropy_difference")
def cross_entropy_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Target: the documents labelled good; background: all documents."""
    docs = read(spark, sf, "documents")
    models = cross_entropy.learn(docs, read(spark, sf, "labels").filter("quality = 1"))
    return cross_entropy.score(docs, models)


@query("op10_benchmark_overlap")
def benchmark_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.report(decontamination.find(read(spark, sf, "documents"), read(spark, sf, "benchmark")))


@query("op11_balanced_packing")
def balanced_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read(spark, sf, "documents"), BYTE_BPE)


@query("op12_phrase_stripes")
def phrase_stripes(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(read(spark, sf, "documents"))


@query("op13_drift_clusters")
def drift_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return drift_clusters.cluster(read(spark, sf, "embeddings"))
