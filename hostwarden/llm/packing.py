"""Best-fit packing of documents into training sequences of several permitted lengths.

Texts are cut into pieces of at most the largest length and dealt at random into shards of a few thousand pieces, each
packed by itself: largest piece first, into the open bin it leaves the least room in. If none fits, a bin is opened
in the size that costs least per word it can still be filled with; at the end every bin shrinks to the cheapest size
that holds its contents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostwarden.llm.support import prepare
from hostwarden.llm.textbytes import LOWER, SPACE, edges, text_slices
from hostwarden.session import stage

CAPACITIES = (256, 512, 1024, 2048, 4096, 8192)
#: A sequence costs its length and this many words more, so that fewer, longer sequences are cheaper when full.
OVERHEAD = 32
SHARD_PIECES = 4096


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """Bin number of every piece, and the final capacity of every bin. No piece may exceed the largest capacity."""
    sizes = sorted(capacities)
    left = int(sum(lengths))
    bins, room_of, used = [-1] * len(lengths), [], []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if some open bin has room for exactly r words
    for p in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        n = int(lengths[p])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room = min((c for c in sizes if c >= n), key=lambda c: ((c + overhead) / min(c, max(left, 1)), c))
            b = len(used)
            room_of.append(room), used.append(0)
        bins[p], used[b] = b, used[b] + n
        left -= n
        if room > n:
            by_room.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    return bins, [next(c for c in sizes if c >= u) for u in used]


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_slices(batch["text"]):
            start, _ = edges(~SPACE[LOWER[piece.data]], piece.bounds)
            counts = np.bincount(np.searchsorted(piece.bounds[1:], start, "right"), minlength=piece.last - piece.first)
            yield pa.RecordBatch.from_arrays([batch["doc_id"][piece.first : piece.last], pa.array(counts.astype(np.int32))], ["doc_id", "words"])


_PACKED = "bin_id long, capacity int, used int, doc_id long, piece int, start_word int, n_words int, bin_start int"


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """Every piece of ``docs(doc_id, text)`` and its place:
    ``bin_id, capacity, used, doc_id, piece, start_word, n_words, bin_start``.

    Words are runs of characters other than white space. A text longer than the largest capacity gives consecutive
    pieces of that capacity and a rest; texts that are null or without words give no row. A row without ``doc_id`` is
    packed with a null id, repeated rows are packed as often as they occur. Which pieces meet in a shard depends on the
    layout of the input, what each bin may hold does not. Further columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    sizes, most = tuple(sorted(capacities)), max(capacities)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(_lengths, "doc_id long, words int").where("words > 0")
    cut = counted.select("doc_id", "words", F.posexplode(F.sequence(F.lit(0), F.col("words") - 1, F.lit(most))).alias("piece", "start_word"))
    pieces = stage(cut.select("doc_id", "piece", "start_word", F.least(F.lit(most), F.col("words") - F.col("start_word")).alias("n_words"), F.monotonically_increasing_id().alias("seq")), "pack-pieces")
    shards = max(1, -(-pieces.count() // SHARD_PIECES))

    def packed(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n_words", "doc_id", "piece", "seq"], ascending=[False, True, True, True], ignore_index=True)
        bins, kept = best_fit(shard["n_words"].tolist(), sizes, overhead)
        number = int(shard["shard"].iat[0])
        shard["bin"] = bins
        start = shard.groupby("bin")["n_words"].cumsum() - shard["n_words"]
        return pd.DataFrame({
            "bin_id": shard["bin"] + (number << 20), "capacity": [kept[b] for b in bins], "used": shard.groupby("bin")["n_words"].transform("sum"),
            "doc_id": shard["doc_id"], "piece": shard["piece"], "start_word": shard["start_word"], "n_words": shard["n_words"], "bin_start": start,
        })

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("seq"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(packed, _PACKED)
