"""Benchmark decontamination by spaced-seed hashing.

A mask reads some of the words in a window and ignores the others, so a substituted word spoils only the masks that
read it. Masks of all benchmark items and all windows of the training texts are hashed, and so are runs of three words,
of which every overlap keeps one; a bit table of fixed size drops training hashes before the join. A diagonal with a mask,
or with as many runs as no overlap can do without, is verified by comparing the words along it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostwarden.llm.support import bit_table, maybe_in, packed_bits, prepare, unpacked_bits
from hostwarden.llm.textbytes import lists, mix, text_slices, words
from hostwarden.session import stage

#: Read (1) and ignored (0) positions; every mask reads eight words.
MASKS = ("11101100111", "110100110101011", "11110010000101011")
#: Items shorter than the masks are searched by whole windows of their own length, from this number of words on.
MIN_ITEM = 5
MIN_MATCHED, MIN_SHARE = 13, 0.8
#: Run of equal words that any overlap holds: with fewer than one word in four substituted, one of the runs between them has three.
_RUN = 3
#: Runs on one diagonal that any overlap with an item of 13 words or more has; a mask or a whole item counts as many.
_ENOUGH = 3
_SPAN = max(map(len, MASKS))
_COMBINE = np.uint64(0xD6E8FEB86659FD93)


def _masked(hashes: np.ndarray, doc: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows that stay in one text, and the hash of the words that the mask reads there."""
    m = len(hashes) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(m, salt, np.uint64)
    for j, read in enumerate(mask):
        if read == "1":
            total = total * _COMBINE + hashes[j : j + m]
    at = np.flatnonzero(doc[:m] == doc[len(mask) - 1 :])
    return at, mix(total[at])


def _patterns(lengths: tuple[int, ...]) -> list[tuple[int, str]]:
    return [(100 + k, mask) for k, mask in enumerate(MASKS)] + [(n, "1" * n) for n in (_RUN, *lengths)]


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["item_id"].to_numpy(zero_copy_only=False)
        for piece in text_slices(batch["text"]):
            w = words(piece)
            counts = np.bincount(w.doc, minlength=piece.last - piece.first)
            first = np.cumsum(counts) - counts
            seeds, owner, pos = [], [], []
            for salt, mask in _patterns(tuple(range(MIN_ITEM, _SPAN))):
                at, h = _masked(w.hash, w.doc, mask, salt)
                if _RUN < salt < 100:  # only for items of just this length
                    whole = counts[w.doc[at]] == salt
                    at, h = at[whole], h[whole]
                seeds.append(h), owner.append(w.doc[at]), pos.append(at - first[w.doc[at]])
            seeds, owner, pos = (np.concatenate(x) for x in (seeds, owner, pos))
            per = np.bincount(owner, minlength=len(counts))
            order = np.argsort(owner, kind="stable")
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[piece.first : piece.last]), lists(w.hash.view(np.int64), counts, pa.int64()),
                lists(seeds[order].view(np.int64), per, pa.int64()), lists(pos[order].astype(np.int32), per, pa.int32()),
            ], ["item_id", "words", "seeds", "positions"])


def _hit_rows(table, lengths: tuple[int, ...]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = unpacked_bits(table.value)
        for batch in batches:
            for piece in text_slices(batch["text"]):
                w = words(piece)
                first = np.searchsorted(w.doc, np.arange(piece.last - piece.first))
                for salt, mask in _patterns(lengths):
                    at, h = _masked(w.hash, w.doc, mask, salt)
                    some = maybe_in(flags, h.view(np.int64))
                    at, h = at[some], h[some]
                    doc = w.doc[at]
                    weight = np.full(len(at), 1 if salt == _RUN else _ENOUGH, np.int32)
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(piece.first + doc)), pa.array(h.view(np.int64)), pa.array((at - first[doc]).astype(np.int32)), pa.array(weight)], ["doc_id", "seed", "pos", "weight"])

    return rows


def _word_rows(table):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = unpacked_bits(table.value)
        for batch in batches:
            batch = batch.filter(pa.array(maybe_in(flags, batch["doc_id"].to_numpy(zero_copy_only=False))))
            for piece in text_slices(batch["text"]):
                w = words(piece)
                counts = np.bincount(w.doc, minlength=piece.last - piece.first)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][piece.first : piece.last], lists(w.hash.view(np.int64), counts, pa.int64())], ["doc_id", "words"])

    return rows


def best_overlap(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """The segment of two aligned word sequences where equal words outweigh thrice the different ones: start, end, equal words."""
    n = min(len(item), len(window))
    same = item[:n] == window[:n]
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -3))])
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end, int(same[start:end].sum())


def longest_overlap(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """The longest segment of two aligned word sequences with less than one word in four different: start, end, equal words."""
    n = min(len(item), len(window))
    same = item[:n] == window[:n]
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -3))])
    high = np.maximum.accumulate(total[::-1])[::-1]
    low, start, best = np.minimum.accumulate(total), 0, (0, 0)
    for end in range(n + 1):
        while start < end and low[start] >= high[end]:
            start += 1
        if end - start > best[1] - best[0]:
            best = start, end
    start, end = best
    inside = start + np.flatnonzero(same[start:end])
    return (int(inside[0]), int(inside[-1]) + 1, len(inside)) if len(inside) else (0, 0, 0)


def least_equal(words_of_item: int) -> int:
    """Equal words that an overlap with an item of so many words needs: 13, or four fifths of a shorter item and no fewer than five."""
    return min(MIN_MATCHED, max(MIN_ITEM, -(-4 * words_of_item // 5)))


_FOUND = "doc_id long, item_id long, start_word int, end_word int, equal_words int, item_words int"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, item, diagonal, a, b in zip(batch["doc_id"].to_pylist(), batch["item_id"].to_pylist(), batch["diagonal"].to_pylist(), batch["item_words"], batch["window"]):
            a, b = (x.values.to_numpy(zero_copy_only=False) for x in (a, b))
            shift = max(0, -diagonal)
            start, end, equal = best_overlap(a[shift:], b)
            if equal < min(MIN_MATCHED, len(a)):  # a changed word near an end can cost that end its words
                start, end, equal = longest_overlap(a[shift:], b)
            if equal >= least_equal(len(a)):
                out.append((doc, item, max(0, diagonal) + start, max(0, diagonal) + end, equal, len(a)))
        columns = list(zip(*out)) or [[]] * 6
        kinds = [pa.int64()] * 2 + [pa.int32()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "start_word", "end_word", "equal_words", "item_words"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Overlaps of ``docs(doc_id, text)`` with ``benchmark(item_id, text)``, one row per document and item:
    ``doc_id, item_id, start_word, end_word, equal_words, item_words``, the overlap with most equal words.

    An overlap holds 13 equal words, or four fifths and at least 5 of the words of a shorter item, with less than one word
    in four substituted; none is missed. Items of fewer than 5 words prove nothing and never match. Words are runs of characters other than white space, A-Z lowered. Rows without id or text match nothing,
    repeated rows give one row. Further columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND length(text) > 0")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND length(text) > 0").distinct()
    items = stage(items.mapInArrow(_item_rows, "item_id long, words array<long>, seeds array<long>, positions array<int>"), "bench-items")
    keyed = items.select("item_id", F.size("words").alias("n"), F.explode(F.arrays_zip("seeds", "positions")).alias("z")).select("item_id", "n", F.col("z.seeds").alias("seed"), F.col("z.positions").alias("item_pos")).where(f"n >= {MIN_ITEM}")
    keyed = stage(keyed, "bench-seeds")
    lengths = tuple(sorted(r["n"] for r in keyed.where(f"n < {_SPAN}").select("n").distinct().collect()))  # fewer than a mask is long
    table = spark.sparkContext.broadcast(packed_bits(bit_table(keyed, "seed")))
    hits = texts.mapInArrow(_hit_rows(table, lengths), "doc_id long, seed long, pos int, weight int")
    diagonals = hits.join(keyed, "seed").groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "n").agg(F.sum("weight").alias("weight"))
    # A substituted word spoils three runs, and of a shorter item one word in five can be substituted.
    runs = F.col("n") - (_RUN - 1) - _RUN * F.expr("n div 5")
    found = stage(diagonals.where(F.col("weight") >= F.when(F.col("n") < MIN_MATCHED, F.least(F.lit(_ENOUGH), F.greatest(F.lit(1), runs))).otherwise(_ENOUGH)).drop("weight"), "bench-diagonals")
    leaky = spark.sparkContext.broadcast(packed_bits(bit_table(found, "doc_id")))
    sequences = texts.mapInArrow(_word_rows(leaky), "doc_id long, words array<long>")
    window = F.slice("words", F.greatest(F.lit(0), F.col("diagonal")) + 1, F.col("n") + F.least(F.lit(0), F.col("diagonal")))
    windows = stage(found.join(sequences, "doc_id").select("doc_id", "item_id", "diagonal", window.alias("window")), "bench-windows")
    checked = windows.join(items.select("item_id", F.col("words").alias("item_words")), "item_id").mapInArrow(_verified, _FOUND)
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct("equal_words", (-F.col("start_word")).alias("s"), "end_word", "item_words")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.s")).alias("start_word"), "m.end_word", "m.equal_words", "m.item_words")


def clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` without an overlap in ``found``; rows without an id stay."""
    return docs.join(stage(found.select("doc_id").distinct(), "bench-leaks"), "doc_id", "left_anti").select(docs.columns)
