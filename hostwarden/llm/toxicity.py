"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick over folded text.

Folding undoes look-alike letters of other scripts and digits or signs written for letters. The lexicon holds words
and word beginnings whose presence goes with the label, weighted by log odds; it is learned from labelled rows. Hits
inside an exception phrase do not count. A logistic curve over the hits, normalised by length, gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostwarden.llm.support import prepare
from hostwarden.llm.textbytes import salted, shingle_sets, text_slices
from hostwarden.session import stage

#: About this many labelled rows are used for training, chosen by a hash of their id.
MAX_LABELLED = 40_000
#: Entries kept of the lexicon, and the least evidence (likelihood ratio statistic) and texts for one.
MAX_ENTRIES, MIN_EVIDENCE, MIN_TEXTS = 512, 24.0, 3
_PREFIXES = range(4, 11)
_FLUSH = 200_000
#: Letters of other scripts that look like Latin ones, and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m",
    "т": "t", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
#: Harmless phrases around words that may be in a lexicon.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "sore loser", "idiot proof")

_LOOKS, _SIGNS = str.maketrans(HOMOGLYPHS), str.maketrans(SIGNS)
_TOKEN = re.compile(r"[^\W_]+(?:[@$!|]+[^\W_]+)*")


def fold(text: str) -> str:
    """Words of a text in one spelling, each after one blank, with a blank at the end. ``l`` reads as ``i``, as 1 does."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_LOOKS)
    return f" {' '.join(_TOKEN.findall(text.lower()))} ".translate(_SIGNS)


@dataclass(frozen=True)
class Model:
    lexicon: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    curve: tuple[float, ...]


def automaton(model: Model) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for phrase in model.exceptions:
        machine.add_word(fold(phrase), (len(fold(phrase)), None))
    for entry, weight in model.lexicon:
        if entry not in machine:
            machine.add_word(entry, (len(entry), weight))
    machine.make_automaton()
    return machine


def hits(machine: ahocorasick.Automaton, folded: str) -> tuple[float, int]:
    """Summed weight and number of the lexicon hits outside exception phrases; of hits in one word the heaviest counts."""
    found, spared = {}, []
    for end, (size, weight) in machine.iter(folded) if len(machine) else ():
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        else:
            found[start] = max(weight, found.get(start, weight))
    counted = [w for start, w in found.items() if not any(a <= start < b for a, b in spared)]
    return sum(counted), len(counted)


def features(weight: float, count: int, words: int) -> list[float]:
    return [1.0, math.log1p(1000 * weight / (words + 20)), math.log1p(weight), math.log1p(count)]


def _entries(folded: str) -> set[str]:
    out = set()
    for word in set(folded.split()):
        if len(word) > 2:
            out.add(f" {word} ")
            out.update(f" {word[:k]}" for k in _PREFIXES if k <= len(word))
    return out


def _entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["entry", "clean", "toxic"])
        counts.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"].to_pylist()):
            for entry in _entries(fold(text.as_py() or "")):
                counts[entry][toxic] += 1
            if len(counts) > _FLUSH:
                yield flushed()
    yield flushed()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_slices(batch["text"]):
            docs, tokens = shingle_sets(piece, 3)
            least = np.zeros(piece.last - piece.first, np.uint64)
            if len(docs):
                heads = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
                least[docs[heads]] = np.minimum.reduceat(salted(tokens, 9), heads)
            yield pa.RecordBatch.from_arrays([batch["doc_id"][piece.first : piece.last], pa.array(least.view(np.int64))], ["doc_id", "print"])


def _evidence(p: int, n: int, toxic: int, clean: int) -> float:
    """Likelihood ratio statistic of a two-by-two table."""
    out, total = 0.0, toxic + clean
    for seen, row, column in ((p, p + n, toxic), (n, p + n, clean), (toxic - p, total - p - n, toxic), (clean - n, total - p - n, clean)):
        if seen > 0:
            out += 2 * seen * math.log(seen * total / (row * column))
    return out


def _pruned(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> list[tuple[str, float]]:
    """Entries by evidence, longest first among equals, without those that only begin or extend a better one."""
    kept: list[tuple[str, float]] = []
    for entry, n, p in sorted(rows, key=lambda r: (-_evidence(r[2], r[1], toxic, clean), -len(r[0]), r[0])):
        bare = entry.strip()
        if not any(bare.startswith(k.strip()) or k.strip().startswith(bare) for k, _ in kept):
            kept.append((entry, math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))))
        if len(kept) == MAX_ENTRIES:
            break
    return kept


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(labelled: DataFrame, exceptions: Sequence[str] = EXCEPTIONS, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from ``labelled(doc_id, text, toxic)``; of texts that share their least shingle only one counts.

    Rows without id or label are left out. With one class only, or none, the lexicon is empty.
    """
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    share = min(1.0, max_labelled / max(1, rows.count()))
    sample = stage(rows.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))), "toxic-sample")
    one = sample.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, print long").groupBy("print").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    sample = stage(sample.join(stage(one, "toxic-one"), "doc_id", "left_semi").repartition("doc_id"), "toxic-texts")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model((), tuple(exceptions), (math.log((toxic + 0.5) / (clean + 1.5)), 0.0, 0.0, 0.0))
    counted = sample.select("text", "toxic").mapInArrow(_entry_rows, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lifted = counted.where((F.col("toxic") >= MIN_TEXTS) & (F.col("toxic") * clean > 3 * F.col("clean") * toxic))
    top = lifted.orderBy(F.desc(F.col("toxic") / (F.col("clean") + 1)), F.desc("toxic"), "entry").limit(8 * MAX_ENTRIES).collect()
    rows = [(r["entry"], r["clean"], r["toxic"]) for r in top if _evidence(r["toxic"], r["clean"], toxic, clean) >= MIN_EVIDENCE]
    model = Model(tuple(_pruned(rows, toxic, clean)), tuple(exceptions), (0.0, 0.0, 0.0, 0.0))
    measured = sample.select("toxic", "text").mapInArrow(_hit_rows(model, ["toxic"]), "toxic int, weight double, hits int, words int").collect()
    x = np.array([features(r["weight"], r["hits"], r["words"]) for r in measured])
    curve = _logistic(x, np.array([r["toxic"] for r in measured], float))
    return Model(model.lexicon, model.exceptions, tuple(map(float, curve)))


def _hit_rows(model: Model, keys: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(model)
        for batch in batches:
            weights, counts, words = [], [], []
            for text in batch["text"]:
                folded = fold(text.as_py() or "")
                weight, count = hits(machine, folded)
                weights.append(weight), counts.append(count), words.append(folded.count(" ") - 1)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keys), pa.array(weights, pa.float64()), pa.array(counts, pa.int32()), pa.array(words, pa.int32())], [*keys, "weight", "hits", "words"])

    return rows


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, score, predicted, hits, weight, words``.

    The score is between 0 and 1; predicted is 1 from 0.5 on. A null or empty text scores as one without hits.
    Repeated rows and rows without id are scored each. Further columns are ignored.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_hit_rows(model, ["doc_id"]), "doc_id long, weight double, hits int, words int")
    terms = (F.lit(1.0), F.log1p(1000 * F.col("weight") / (F.col("words") + 20)), F.log1p("weight"), F.log1p("hits"))
    z = sum((F.lit(w) * t for w, t in zip(model.curve, terms)), F.lit(0.0))
    scored = found.withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits", "weight", "words")


def held_out(doc_id="doc_id"):
    """Rows whose labels are kept from training: the CRC-32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
