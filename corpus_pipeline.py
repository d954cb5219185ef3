"""Corpus pipeline: language, near copies, repeated passages, benchmark leaks, packing; each stage a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostwarden.llm import decontamination, language_id, ngram_jaccard, packing, substring_dedup
from hostwarden.session import configure, stage


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the model is counted from all documents that declare one."""
    key = F.xxhash64("text").alias("__text")
    items = language_id.document_items(docs).select("*", key)
    found = language_id.identify(items, language_id.train(docs), ["doc_id", "__text"])
    rejected = stage(found.where("NOT accepted").select(F.col("doc_id").alias("__id"), "__text").distinct(), "pipeline-rejected")
    same = docs["doc_id"].eqNullSafe(rejected["__id"]) & (F.xxhash64(docs["text"]) == rejected["__text"])
    return docs.join(rejected, same, "left_anti")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return ngram_jaccard.one_of_each(docs, 5, 80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out."""
    return substring_dedup.remove_passages(docs, stage(substring_dedup.repeated_passages(docs), "pipeline-passages"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean(docs, stage(decontamination.contaminated(docs, benchmark), "pipeline-leaks"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: where each piece of each document stands."""
    return packing.pack(docs)


STAGES = [
    ("language_id", in_known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", without_repeated_passages),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: Chaining and packing cannot be expressed in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
