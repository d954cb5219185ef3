"""Language identification that fuses text, markup and address evidence by Bayes' rule.

Text likelihoods come from byte trigrams of all labelled texts, counted into a table of fixed size. What a text alone
says, counted by declared language, address suffix and host, gives the reliability of declarations and priors of
hosts; a host's prior is smoothed towards its suffix, and the suffix's towards the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostwarden.llm.support import prepare, summed_table
from hostwarden.llm.textbytes import LOWER, Slice, text_slices
from hostwarden.session import stage

_GRAMS = 1 << 16
#: The languages of a model: those with most labelled rows, up to this many.
MAX_LANGUAGES = 64
#: Weight of a trigram, as neighbouring ones overlap; pseudo-counts of the smoothed tables; least probability accepted.
TEXT_WEIGHT, SMOOTH, ACCEPT = 0.3, 20.0, 0.5
#: Letters stay, all other ASCII bytes count as a blank.
_LETTERS = np.where((np.arange(256) >= 128) | ((LOWER >= 97) & (LOWER <= 122)), LOWER, 32).astype(np.uint8)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # one row per language, the last one for text in none of them


def code(column):
    """Primary subtag of a language code, null unless it has two or three letters."""
    tag = F.lower(F.regexp_extract(F.trim(column.cast("string")), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(tag != "", tag)


def _trigrams(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Text and table cell of every trigram that has a letter at its middle."""
    b = _LETTERS[piece.data].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cell = ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    inside = b[1:-1] != 32
    ends = piece.bounds[1:-1]
    for back in (1, 2):
        at = ends - back
        inside[at[(at >= 0) & (at < len(inside))]] = False
    at = np.flatnonzero(inside)
    return np.searchsorted(piece.bounds[1:], at, "right"), cell[at].astype(np.int64)


def train(labelled: DataFrame) -> Model:
    """A model from all rows of ``labelled(text, lang)`` that have a text and a language code."""
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col("text").cast("string").alias("text"), code(F.col("lang")).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    top = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    languages = tuple(sorted(r["lang"] for r in top.collect()))

    def accumulate(batch: pa.RecordBatch, table: np.ndarray) -> None:
        number = {name: k for k, name in enumerate(languages)}
        of = np.array([number.get(x, -1) for x in batch["lang"].to_pylist()], np.int64)
        for piece in text_slices(batch["text"]):
            doc, cell = _trigrams(piece)
            own = of[piece.first + doc]
            table += np.bincount((own * _GRAMS + cell)[own >= 0], minlength=table.size).reshape(table.shape)

    counts = summed_table(rows, accumulate, (max(1, len(languages)), _GRAMS))[: len(languages)].astype(float)
    prob = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * _GRAMS)
    return Model(languages, np.log(np.vstack([prob, np.full((1, _GRAMS), 1.0 / _GRAMS)])).astype(np.float32))


def _likelihoods(model, keys: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            for piece in text_slices(batch["text"]):
                doc, cell = _trigrams(piece)
                n = piece.last - piece.first
                sums = np.stack([np.bincount(doc, weights=row[cell], minlength=n) for row in table], axis=1) if len(doc) else np.zeros((n, len(table)))
                scores = pa.FixedSizeListArray.from_arrays(pa.array((TEXT_WEIGHT * sums).ravel()), len(table))
                kept = [batch[c][piece.first : piece.last] for c in keys]
                yield pa.RecordBatch.from_arrays([*kept, scores.cast(pa.list_(pa.float64())), pa.array(np.bincount(doc, minlength=n).astype(np.int64))], [*keys, "scores", "trigrams"])

    return rows


def _log_array(values):
    return F.array(*(F.lit(float(x)) for x in np.log(values)))


def identify(items: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """One row per row of ``items(keys..., text, declared, suffix, host)``:
    ``keys..., lang, probability, accepted, text_lang, declared, trigrams``.

    ``lang`` is the likeliest language; it is null where no letters are there or text in no known language is
    likelier. Accepted are rows with a language of probability 0.5 or more. Null evidence says nothing; a declaration
    that is no code of the model counts as such. Repeated rows each get their own result.
    """
    spark = prepare(items.sparkSession)
    names, size = model.languages, len(model.languages) + 1
    known = F.array(*(F.lit(x) for x in names)).cast("array<string>")
    declared = F.when(code(F.col("declared")).isNull(), F.lit("none")).when(F.array_contains(known, code(F.col("declared"))), code(F.col("declared"))).otherwise(F.lit("other"))
    base = items.select(*keys, F.col("text").cast("string").alias("text"), declared.alias("declared"), F.coalesce(F.col("suffix").cast("string"), F.lit("")).alias("suffix"), F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host"))
    carried = [*keys, "declared", "suffix", "host"]
    table = spark.sparkContext.broadcast(model.log_prob)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name in carried)
    scored = base.mapInArrow(_likelihoods(table, [f.name for f in base.schema.fields if f.name in carried]), f"{kinds}, scores array<double>, trigrams long")
    best = F.array_position("scores", F.array_max("scores")).cast("int") - 1
    scored = stage(scored.withColumn("best", F.when(F.col("trigrams") > 0, best)), "language-text")

    # Reliability of declarations: how often each is made over texts that read as each language. (L + 1) x (L + 2) cells.
    said = {(r["declared"], r["best"]): r["n"] for r in scored.where("best IS NOT NULL").groupBy("declared", "best").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = [*names, "other", "none"]
    cells = np.array([[said.get((d, k), 0) for k in range(size)] for d in labels], float)
    overall = (cells.sum(axis=0) + 1) / (cells.sum() + size)
    prior = (cells.sum(axis=1, keepdims=True) + 1) / (cells.sum() + len(labels))
    reliability = (cells + SMOOTH * prior) / (cells.sum(axis=0, keepdims=True) + SMOOTH)
    claims = F.create_map(*(x for d, row in zip(labels, reliability) for x in (F.lit(d), _log_array(row))))

    def tallies(keys: list[str], name: str) -> DataFrame:
        counts = [F.count(F.when(F.col("best") == k, 1)).cast("double") for k in range(size)]
        return scored.where("best IS NOT NULL").groupBy(*keys).agg(F.array(*counts).alias(name))

    def smoothed(counts: str, towards):
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, towards, lambda n, p: (n + SMOOTH * p) / (total + SMOOTH))

    flat = F.array(*(F.lit(float(x)) for x in overall))
    suffixes = tallies(["suffix"], "by_suffix").select("suffix", smoothed("by_suffix", flat).alias("suffix_prior"))
    hosts = tallies(["suffix", "host"], "by_host").join(suffixes, "suffix")
    hosts = stage(hosts.select("suffix", "host", F.transform(smoothed("by_host", F.col("suffix_prior")), lambda p: F.ln(p)).alias("host_prior")), "language-hosts")

    joined = scored.join(hosts, ["suffix", "host"], "left")
    prior = F.coalesce("host_prior", F.transform(flat, lambda p: F.ln(p)))
    fused = F.zip_with(F.zip_with("scores", claims[F.col("declared")], lambda a, b: a + b), prior, lambda a, b: a + b)
    top = F.array_max("fused")
    probability = 1 / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    every = F.array(*(F.lit(x) for x in names), F.lit(None).cast("string"))
    out = joined.withColumn("fused", fused).select(
        *keys, F.when(F.col("trigrams") > 0, every[F.array_position("fused", top).cast("int") - 1]).alias("lang"),
        F.when(F.col("trigrams") > 0, probability).alias("probability"), every[F.col("best")].alias("text_lang"), "declared", "trigrams",
    )
    return out.withColumn("accepted", F.col("lang").isNotNull() & (F.col("probability") >= ACCEPT))


def page_items(pages: DataFrame) -> DataFrame:
    """Text, declared language, host and address suffix of ``pages(page_id, url, html)``."""
    html = F.col("html").cast("string")
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    host = F.lower(F.try_parse_url(F.col("url").cast("string"), F.lit("HOST")))
    return pages.select(
        "page_id", text.alias("text"), F.regexp_extract(html, r"""(?i)<html[^>]*?\blang\s*=\s*["']?([A-Za-z_-]+)""", 1).alias("declared"),
        F.when(host.contains("."), F.substring_index(host, ".", -1)).alias("suffix"), host.alias("host"),
    )


def document_items(docs: DataFrame) -> DataFrame:
    """The same of ``docs(doc_id, text, lang, source)``: the source stands for the host, the given code is a declaration."""
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))
