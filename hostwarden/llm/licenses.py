"""Licence scan by a trained paragraph classifier, confirmed against templates.

Paragraphs are lines, or overlapping windows of long lines. Hashed word 1- to 3-grams feed a multinomial logistic
regression over licence families and an unknown class; it is trained on the templates below, varied by rule, against a
bounded sample of the corpus, and its temperature is fitted on held-out rows. A prediction that is likely enough is
compared with the templates of its family, which confirms it or not.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostwarden.llm.support import prepare
from hostwarden.llm.textbytes import Slice, ngrams, salted, text_slices, words

#: Usual wordings of licence notices by family.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.", "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright to this work to the public domain.", "Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
}
_CELLS = 1 << 15
#: Paragraphs sampled from the corpus for the unknown class, the least ones by a hash of their words.
MAX_NEGATIVES = 4000
LONGEST, STEP = 64, 32
LIKELY, SIMILAR = 0.5, 0.6
#: Letters, digits and bytes beyond ASCII make words; a hyphen does too, as families differ by it.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 45]] = True


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    weights: np.ndarray  # cells x (families + unknown)
    bias: np.ndarray
    temperature: float


@dataclass
class Paragraphs:
    """Windows of words: number of the text, first and last word (exclusive) in the slice."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def paragraphs(piece: Slice, w) -> Paragraphs:
    """Lines as runs of words; lines of more than 64 words as windows of 64, one every 32."""
    n = len(w.doc)
    if not n:
        empty = np.zeros(0, np.int64)
        return Paragraphs(empty, empty, empty)
    lines = np.cumsum(np.isin(piece.data, (10, 13)))[w.start]
    new = np.concatenate([[True], (lines[1:] != lines[:-1]) | (w.doc[1:] != w.doc[:-1])])
    start = np.flatnonzero(new)
    end = np.concatenate([start[1:], [n]])
    windows = np.maximum(1, -(-(end - start - STEP) // STEP))
    of = np.repeat(np.arange(len(start)), windows)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    first = start[of] + STEP * nth
    return Paragraphs(w.doc[first], first, np.minimum(first + LONGEST, end[of]))


def _cells(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell of every word n-gram, and whether it counts: not where the same one stood up to three words before."""
    _, h = ngrams(hashes, np.zeros(len(hashes), np.int8), n)
    new = np.ones(len(h), bool)
    for back in (1, 2, 3):
        new[back:] &= h[back:] != h[:-back]
    return (salted(h, n) & np.uint64(_CELLS - 1)).astype(np.int64), new


def scores(piece: Slice, w, p: Paragraphs, model: Model) -> np.ndarray:
    """Probability of every class for every paragraph; n-grams weigh one over the root of their number."""
    z = np.zeros((len(p.start), len(model.bias)))
    size = np.zeros(len(p.start))
    for n in (1, 2, 3):
        cells, new = _cells(w.hash, n)
        lo = np.minimum(p.start, len(cells))
        hi = np.clip(p.end - n + 1, lo, len(cells))
        running = np.zeros((len(cells) + 1, z.shape[1]), np.float64)
        np.cumsum(model.weights[cells] * new[:, None], axis=0, out=running[1:])
        count = np.concatenate([[0], np.cumsum(new)])
        z += running[hi] - running[lo]
        size += count[hi] - count[lo]
    z = (model.bias + z / np.sqrt(np.maximum(size, 1))[:, None]) / model.temperature
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def _rows_of(texts: list[str]) -> list[np.ndarray]:
    """Feature cells of short texts, each one paragraph."""
    out = []
    for piece in text_slices(pa.array([t.replace("\n", " ") for t in texts])):
        w = words(piece, solid=_SOLID)
        for d in range(piece.last - piece.first):
            own = w.hash[slice(*np.searchsorted(w.doc, [d, d + 1]))]
            out.append(np.concatenate([cells[new] for cells, new in (_cells(own, n) for n in (1, 2, 3))]))
    return out


def _varied(rng: np.random.Generator, sentence: str, filler: list[str]) -> str:
    """A wording with a few words lost or changed, and other words around it."""
    own = [x for x in sentence.split() if rng.random() > 0.04]
    around = [filler[k] for k in rng.integers(0, len(filler), rng.integers(0, 12) if rng.random() < 0.5 else rng.integers(12, LONGEST))] if filler else []
    cut = int(rng.integers(0, len(around) + 1))
    return " ".join([*around[:cut], *own, *around[cut:]])


def _least_paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best: list[tuple[int, str]] = []
    for batch in batches:
        for piece in text_slices(batch["text"]):
            w = words(piece, solid=_SOLID)
            p = paragraphs(piece, w)
            if not len(p.start):
                continue
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted(w.hash, 21), dtype=np.uint64)])
            h = salted(total[p.end] - total[p.start], 22) >> np.uint64(1)
            low = np.argsort(h, kind="stable")[:MAX_NEGATIVES]
            for k in low:
                key = -int(h[k])
                if len(best) >= MAX_NEGATIVES and key <= best[0][0]:
                    break
                text = piece.data[w.start[p.start[k]] : w.end[p.end[k] - 1]].tobytes().decode("utf-8", "replace")
                (heapq.heappush if len(best) < MAX_NEGATIVES else heapq.heapreplace)(best, (key, text))
    yield pa.RecordBatch.from_arrays([pa.array([-k for k, _ in best], pa.int64()), pa.array([t for _, t in best], pa.string())], ["h", "paragraph"])


def train(docs: DataFrame, negatives: int = MAX_NEGATIVES, seed: int = 5) -> Model:
    """A model from the templates and a sample of at most ``negatives`` paragraphs of ``docs(text)``.

    Sampled paragraphs that hold most of the words of a template are left out, as they may be notices.
    """
    prepare(docs.sparkSession)
    sample = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_least_paragraphs, "h long, paragraph string")
    least = sample.groupBy("h").agg(F.min("paragraph").alias("paragraph")).orderBy("h").limit(negatives).toArrow()["paragraph"].to_pylist()
    own = [set(_plain(t)) for group in TEMPLATES.values() for t in group]
    least = [t for t in least if not any(len(o & set(_plain(t))) >= 0.6 * len(o) for o in own)]
    return fit(least, seed)


def _plain(text: str) -> list[str]:
    return [x.strip("()\".,;:") for x in text.lower().split()]


def fit(unknown: list[str], seed: int = 5, rounds: int = 120) -> Model:
    rng = np.random.default_rng(seed)
    filler = [x for t in unknown[:500] for x in t.split()]
    families = tuple(TEMPLATES)
    texts, labels = list(unknown), [len(families)] * len(unknown)
    for k, family in enumerate(families):
        for sentence in TEMPLATES[family]:
            texts += [sentence] + [_varied(rng, sentence, filler) for _ in range(24)]
            labels += [k] * 25
    # Words of notices without their notice: what only looks like one is unknown.
    vocabulary = [x for group in TEMPLATES.values() for t in group for x in t.split()]
    for _ in range(300):
        texts.append(" ".join(vocabulary[k] for k in rng.integers(0, len(vocabulary), rng.integers(1, 5))) + " " + " ".join(filler[k] for k in rng.integers(0, len(filler), 12)) if filler else vocabulary[0])
        labels.append(len(families))
    rows, y = _rows_of(texts), np.array(labels)
    held = rng.random(len(rows)) < 0.2
    classes = len(families) + 1
    cells = np.concatenate(rows)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weights, bias = np.zeros((_CELLS, classes)), np.zeros(classes)
    grad_sum, bias_sum = np.full_like(weights, 1e-8), np.full_like(bias, 1e-8)
    scale = 1 / np.sqrt([max(1, len(r)) for r in rows])
    onehot = np.eye(classes)[y]
    use = ~held
    cost = 1 / np.bincount(y, minlength=classes).clip(1)[y]
    cost *= len(y) / cost.sum()

    def logits() -> np.ndarray:
        picked = weights[cells]
        return bias + scale[:, None] * np.stack([np.bincount(of, picked[:, c], len(rows)) for c in range(classes)], axis=1)

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for _ in range(rounds):
        error = (softmax(logits()) - onehot) * (use * cost)[:, None]
        grad = np.stack([np.bincount(cells, (error[:, c] * scale)[of], _CELLS) for c in range(classes)], axis=1) + 0.002 * weights
        grad_sum += grad**2
        bias_sum += error.sum(axis=0) ** 2
        weights -= 0.3 * grad / np.sqrt(grad_sum)
        bias -= 0.3 * error.sum(axis=0) / np.sqrt(bias_sum)
    z = logits()[held]
    loss = lambda t: -np.log(softmax(z / t)[np.arange(held.sum()), y[held]] + 1e-12).mean()
    temperature = min((0.25 * 1.1**k for k in range(40)), key=loss) if held.any() else 1.0
    return Model(families, weights.astype(np.float32), bias, float(temperature))


def similarity(text: str, family: str) -> float:
    """The largest share of a template's 3-grams (its words, if fewer) that a paragraph holds."""
    mine, best = _plain(text), 0.0
    for template in TEMPLATES[family]:
        theirs = _plain(template)
        n = min(3, len(theirs))
        grams = {tuple(theirs[k : k + n]) for k in range(len(theirs) - n + 1)}
        best = max(best, len(grams & {tuple(mine[k : k + n]) for k in range(len(mine) - n + 1)}) / len(grams))
    return best


_FOUND = "doc_id long, start_word int, n_words int, family string, probability double, similarity double, confirmed boolean, notice string"


def _scanned(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, out = batch["doc_id"].to_pylist(), []
            for piece in text_slices(batch["text"], 1 << 18):
                w = words(piece, solid=_SOLID)
                p = paragraphs(piece, w)
                if not len(p.start):
                    continue
                probability = scores(piece, w, p, model)
                first_word = np.searchsorted(w.doc, np.arange(piece.last - piece.first))
                for k in np.flatnonzero(probability[:, :-1].max(axis=1) >= LIKELY):
                    best = int(probability[k, :-1].argmax())
                    text = piece.data[w.start[p.start[k]] : w.end[p.end[k] - 1]].tobytes().decode("utf-8", "replace")
                    alike = similarity(text, model.families[best])
                    out.append((ids[piece.first + p.doc[k]], int(p.start[k] - first_word[p.doc[k]]), int(p.end[k] - p.start[k]), model.families[best], float(probability[k, best]), alike, alike >= SIMILAR, text))
            columns = list(zip(*out)) or [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "start_word", "n_words", "family", "probability", "similarity", "confirmed", "notice"])

    return rows


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Paragraphs of ``docs(doc_id, text)`` to which one family is at least as likely as all else, one row each:
    ``doc_id, start_word, n_words, family, probability, similarity, confirmed, notice``.

    ``start_word`` counts words of letters, digits and hyphens. A window of a long line may repeat what its neighbour
    holds. Null and empty texts give no row; repeated rows and rows without id are scanned each. Further columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scanned(spark.sparkContext.broadcast(model)), _FOUND)
