"""The registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostwarden.llm import conversation_repair, decontamination, embedding_dedup, importance, language_id, licenses, ngram_jaccard, packing, substring_dedup, suffix_dedup, toxicity, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(ngram_jaccard.SQL)
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 3-word shingle sets link at 90 percent."""
    return ngram_jaccard.similarity_classes(table(spark, sf_dir, "documents"), 3, 90)


@query()
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages that an earlier document has too."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 256 to 8192 words."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and every page; either id is null."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    rows = language_id.document_items(docs).unionByName(language_id.page_items(pages), allowMissingColumns=True)
    return language_id.identify(rows, language_id.train(docs), ["doc_id", "page_id"])


@query()
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of documents with benchmark items."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = docs.select("doc_id", "text").join(labels.select("doc_id", "toxic").where(~toxicity.held_out()), "doc_id")
    scored = toxicity.score(docs, toxicity.train(labelled))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "hits", "words")


@query()
def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


@query(embedding_dedup.SQL)
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of vectors that link at a cosine of 0.9."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


@query()
def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents resampled towards those labelled good, but for the held-out labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = labels.where((F.col("quality") == 1) & ~toxicity.held_out()).select("doc_id")
    return importance.resample(docs, importance.train(docs, good))


@query()
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


@query(conversation_repair.SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


@query(suffix_dedup.SQL)
def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings of 400 bytes."""
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


@query()
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on its first 16 whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
