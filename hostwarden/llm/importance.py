"""Importance resampling: keep raw texts in proportion to how much they look like target text.

Two generative models over hashed word unigrams and bigrams, one counted from target texts and one from all texts,
give every text the logarithm of their ratio. Adding Gumbel noise and keeping the largest keys draws a sample without
replacement in proportion to the weights. The k-th largest key is found by counting digits, so nothing is sorted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostwarden.llm.support import prepare, summed_table
from hostwarden.llm.textbytes import Slice, ngrams, text_slices, words
from hostwarden.session import stage

_CELLS = 1 << 13
#: Share of the rows that the sample keeps.
SHARE = 0.85
#: About this many target documents are counted at most.
MAX_TARGET = 100_000


@dataclass(frozen=True)
class Model:
    log_ratio: np.ndarray


def _cells(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    w = words(piece)
    at, pairs = ngrams(w.hash, w.doc, 2)
    hashes = np.concatenate([w.hash, pairs])
    return np.concatenate([w.doc, w.doc[at]]), (hashes >> np.uint64(51)).astype(np.int64)


def train(docs: DataFrame, target: DataFrame, max_target: int = MAX_TARGET) -> Model:
    """From ``docs(doc_id, text)``: counts of all texts, and of those whose id is in ``target(doc_id)``.

    Of more than about ``max_target`` ids a share is used, chosen by a hash, so that the driver and each task hold a
    list of bounded size and no text has to meet its label in a shuffle.
    """
    prepare(docs.sparkSession)
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    share = min(1.0, max_target / max(1, ids.count()))
    chosen = ids.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    listed = docs.sparkSession.sparkContext.broadcast(np.sort(chosen.toArrow()["doc_id"].to_numpy()))

    def accumulate(batch: pa.RecordBatch, table: np.ndarray) -> None:
        target = np.isin(batch["doc_id"].fill_null(-1).to_numpy(), listed.value) & batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
        for piece in text_slices(batch["text"]):
            doc, cell = _cells(piece)
            table[0] += np.bincount(cell, minlength=_CELLS)
            table[1] += np.bincount(cell[target[piece.first + doc]], minlength=_CELLS)

    counts = summed_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), accumulate, (2, _CELLS)).astype(float)
    raw = (counts[0] + 1) / (counts[0].sum() + _CELLS)
    # Smoothed towards the raw model by about ten n-grams a cell, fewer where the target is a small part.
    pseudo = 10 * _CELLS * counts[1].sum() / max(1.0, counts[0].sum())
    target = (counts[1] + pseudo * raw) / (counts[1].sum() + pseudo) if pseudo else raw
    return Model(np.log(target) - np.log(raw))


def _weighed(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            for piece in text_slices(batch["text"]):
                doc, cell = _cells(piece)
                n = piece.last - piece.first
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"][piece.first : piece.last], pa.array(np.bincount(doc, weights=table[cell], minlength=n)), pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
                ], ["doc_id", "log_weight", "n_grams"])

    return rows


def kth_largest(values: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a long column without nulls: four counts by 16-bit digits, 65,536 numbers each at most."""
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        same = values if shift == 48 else values.where(F.shiftright(column, shift + 16) == prefix)
        digit = F.shiftright(column, 48) if shift == 48 else F.shiftright(column, shift).bitwiseAND(F.lit(65535))
        for d, n in sorted(((r["d"], r["n"]) for r in same.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
            if left <= n:
                prefix = d if shift == 48 else (prefix << 16) | d
                break
            left -= n
        else:
            return None
    return prefix


def resample(docs: DataFrame, model: Model, share: float = SHARE, seed: int = 1) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, log_weight, mean_weight, n_grams, key, selected``.

    ``log_weight`` is the summed log ratio of the two models, ``mean_weight`` that of one n-gram; ``key`` adds Gumbel
    noise, which a hash of id and seed decides. The ``ceil(share * rows)`` largest keys are selected, compared to
    a millionth; rows that tie with the last one are selected too, and so are all copies of a repeated row. A null or
    empty text has weight 0. Further columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = spark.sparkContext.broadcast(model.log_ratio)
    weighed = texts.mapInArrow(_weighed(table), "doc_id long, log_weight double, n_grams long")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))).withColumn("__rank", F.round(F.col("key") * 1e6).cast("long"))
    keyed = stage(keyed, "importance-keys")
    total = keyed.count()
    last = kth_largest(keyed, "__rank", max(1, int(np.ceil(share * total)))) if total else None
    chosen = F.col("__rank") >= F.lit(last) if last is not None else F.lit(False)
    mean = F.when(F.col("n_grams") > 0, F.col("log_weight") / F.col("n_grams")).otherwise(0.0)
    return keyed.select("doc_id", "log_weight", mean.alias("mean_weight"), "n_grams", "key", chosen.alias("selected"))
