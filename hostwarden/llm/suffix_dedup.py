"""Exact removal of byte strings that occur twice, by a depth-limited radix sort of suffixes.

Only the first ``width`` bytes of a suffix count, so a sort that stops at that depth leaves exactly the repeated strings
in equal groups. The passes, most significant digit first, drop every group of one:

1. Sampled suffixes: every window of ``width`` bytes names the position with the least hashed 8-gram in its first
   ``window`` positions. Equal windows name the same position in them, and neighbouring windows mostly the same one, so
   about two positions in ``window`` stand for all. The bytes from there that each of its windows holds are the first digit.
2. Within a group, the bytes of all neighbouring windows that name the position (a cell) are the next digit. A group
   whose cells are all equal is done: every window of it is repeated.
3. Where different cells meet, one of each different cell is cut by the offset of its windows into parts of ``part``. The
   bytes that all windows of a part hold are the next digit, the bytes that any of them holds the one after it.
4. Only where different parts meet are windows dealt singly, by the fewer than ``part`` bytes of them that are left.

A digit is compared by 64 bits of hash on top of the digits before it (the last one by its bytes), so an equal group has 128 equal bits. Groups are
only counted, never gathered, so a passage in a third of all texts is summed in the map tasks and its rows stay spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostwarden.llm.support import prepare
from hostwarden.llm.textbytes import span_hashes, text_slices
from hostwarden.session import release, stage

WIDTH = 400
_GRAM = 8
_BLOCK = 1 << 20
#: Windows of so many neighbouring offsets are a part of a cell, fewer for narrow windows.
PART = 32
_U = np.uint64
_LOW = _U((1 << 32) - 1)


def _named_positions(data: np.ndarray, window: int) -> np.ndarray:
    """For every position the place of the least hashed 8-gram among ``window`` places from there on, the first on ties."""
    padded = np.zeros(len(data) + _GRAM, np.uint8)
    padded[: len(data)] = data
    grams = np.ndarray(len(data), "<u8", padded.data, strides=(1,)).astype(_U)
    grams ^= grams >> _U(29)
    grams *= _U(0x9E3779B97F4A7C15)
    low = (grams & ~_LOW) | np.arange(len(data), dtype=_U)
    span = 1
    while 2 * span <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < window:
        low = np.minimum(low[: span - window], low[window - span :])
    return (low & _LOW).astype(np.int64)


def cells(data: np.ndarray, first: np.ndarray, stop: np.ndarray, width: int, window: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts in ``[first, stop)`` that name the same position: start, number, how far the position is from
    the start, hash of the sampled suffix and hash of all bytes of the run's windows, and how often the run follows itself
    (in periodic text).

    The ranges are ascending and apart, and every window lies in ``data``.
    """
    if not len(first) or len(data) < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U, np.int64))
    named = _named_positions(data, window)
    cuts = np.unique(np.concatenate([np.flatnonzero(named[1:] != named[:-1]) + 1, first, stop]))
    begin, end = cuts[:-1], cuts[1:]
    at = np.searchsorted(first, begin, "right") - 1
    inside = (at >= 0) & (begin < stop[np.maximum(at, 0)])
    begin, end = begin[inside], end[inside]
    n = len(begin)
    key = named[begin]
    hashes = span_hashes(data, np.concatenate([key, begin]), np.concatenate([key + (width - window + 1), end - 1 + width]))
    suffix, whole = hashes[:n], hashes[n:]
    head = np.ones(n, bool)
    head[1:] = (suffix[1:] != suffix[:-1]) | (whole[1:] != whole[:-1]) | (begin[1:] != end[:-1])
    heads = np.flatnonzero(head)
    return begin[heads], (end - begin)[heads], (key - begin)[heads], suffix[heads], whole[heads], np.diff(np.append(heads, n))


def _pieces(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in pieces of bounded size: bytes, then for each text with a window here its row, range of window starts, and
    where it begins (before the piece if that is a later part of a very long text)."""
    for piece in text_slices(column):
        if len(piece.data) <= 2 * _BLOCK:
            first, stop = piece.bounds[:-1], piece.bounds[1:] - (width - 1)
            some = np.flatnonzero(first < stop)
            yield piece.data, some + piece.first, first[some], stop[some], first[some]
            continue
        for lo in range(0, len(piece.data) - width + 1, _BLOCK):
            data = piece.data[lo : lo + _BLOCK + width - 1]
            yield data, np.array([piece.first]), np.zeros(1, np.int64), np.array([len(data) - width + 1]), np.array([-lo])


_CELLS = "d long, t long, start int, n int, far int, times int, suffix long, cell long"


def _cells_of(width: int, window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = (batch[c].to_numpy(zero_copy_only=False) for c in ("d", "t"))
            for data, row, first, stop, origin in _pieces(batch["text"], width):
                begin, n, far, suffix, whole, times = cells(data, first, stop, width, window)
                own = np.searchsorted(first, begin, "right") - 1
                columns = (d[row[own]], t[row[own]], (begin - origin[own]).astype(np.int32), n.astype(np.int32), far.astype(np.int32), times.astype(np.int32), suffix.view(np.int64), whole.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["d", "t", "start", "n", "far", "times", "suffix", "cell"])

    return rows


def parts(data: np.ndarray, start: np.ndarray, n: np.ndarray, far: np.ndarray, width: int, part: int) -> tuple[np.ndarray, ...]:
    """Cells of one text cut into parts by the offset of the named position in the window: number of the cell, least and
    largest offset, hash of what the windows of these ``part`` offsets have in common, hash of all bytes of the part's own
    windows, and the bytes of these before and after the common ones (ends of the byte strings, and the bytes)."""
    place = start + far
    least = far - n + 1
    many = far // part - least // part + 1
    cell = np.repeat(np.arange(len(start)), many)
    number = np.arange(len(cell)) - np.repeat(np.cumsum(many) - many, many) + (least // part)[cell]
    low, high = np.maximum(least[cell], number * part), np.minimum(far[cell], number * part + part - 1)
    at = place[cell]
    core, core_end = at - number * part, at - number * part + width - part + 1
    hull, hull_end = at - high, at + width - low
    # Blocks of the text, so that the hashes of a very long one need bounded memory.
    order = np.argsort(hull, kind="stable")
    hashes = np.zeros((2, len(cell)), _U)
    for some in np.split(order, np.flatnonzero(np.diff(hull[order] // _BLOCK)) + 1):
        if len(some):
            base = int(hull[some].min())
            piece = data[base : int(hull_end[some].max())]
            hashes[0, some], hashes[1, some] = np.split(span_hashes(piece, np.concatenate([core[some], hull[some]]) - base, np.concatenate([core_end[some], hull_end[some]]) - base), 2)
    begins = np.stack([hull, core_end], axis=1).ravel()
    sizes = np.stack([core - hull, hull_end - core_end], axis=1).ravel()
    edges = data[np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)]
    return cell, low, high, hashes[0], hashes[1], np.cumsum(sizes)[1::2], edges


_PARTS = "d long, t long, place int, low int, high int, suffix long, cell long, core long, hull long, edges binary"


def _parts_of(width: int, part: int):
    """The parts of the listed cells of every text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                found = pa.RecordBatch.from_struct_array(batch["cells"][k].values)
                data = next(text_slices(batch["text"].slice(k, 1))).data
                for lo in range(0, len(found), 4096):
                    some = found.slice(lo, 4096)
                    start, n, far = (some[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n", "far"))
                    cell, low, high, core, hull, ends, edges = parts(data, start, n, far, width, part)
                    offsets = np.concatenate([[0], ends]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        *(pa.array(np.full(len(cell), batch[c][k].as_py(), np.int64)) for c in ("d", "t")), pa.array((start + far)[cell].astype(np.int32)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
                        some["suffix"].take(pa.array(cell)), some["cell"].take(pa.array(cell)), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64)),
                        pa.Array.from_buffers(pa.binary(), len(cell), [None, pa.py_buffer(offsets), pa.py_buffer(edges)]),
                    ], ["d", "t", "place", "low", "high", "suffix", "cell", "core", "hull", "edges"])

    return rows


def _texts(docs: DataFrame) -> DataFrame:
    """Texts and a key of two numbers: rows with equal keys have equal texts and get equal results."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64(text, F.col("doc_id").isNull()).alias("t"), text.alias("text"))


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Starts of the windows of ``width`` bytes that start in two places, as runs ``d, t, start, n`` of texts of ``_texts(docs)``."""
    window, part = min(width // 2 + 1, width - _GRAM + 1), min(PART, width // 8)
    texts = _texts(docs).where(F.octet_length("text") >= width)
    sampled = stage(texts.select("d", "t", "text").mapInArrow(_cells_of(width, window), _CELLS), "suffix-cells")
    groups = sampled.groupBy("suffix").agg(F.sum("times").alias("members"), F.min("cell").alias("least"), F.max("cell").alias("most"))
    held = stage(sampled.join(groups.where("members > 1").select("suffix", (F.col("least") != F.col("most")).alias("mixed")), "suffix"), "suffix-held")
    release(sampled)
    every = F.col("n") * F.col("times")
    alike = held.where("NOT mixed").select("d", "t", "start", every.alias("n"))
    mixed = held.where("mixed")
    # One place stands for all equal cells, as all of them are repeated.
    place = F.struct("d", "t", "start", "n", "far")
    different = stage(mixed.groupBy("suffix", "cell").agg(F.sum("times").alias("members"), F.min(place).alias("place")), "suffix-different")
    copied = different.where("members > 1").select("suffix", "cell")
    whole = mixed.join(copied, ["suffix", "cell"], "left_semi").select("d", "t", "start", every.alias("n"))
    wanted = different.select("suffix", "cell", "place.*").groupBy("d", "t").agg(F.collect_list(F.struct("start", "n", "far", "suffix", "cell")).alias("cells"))
    cut = stage(texts.select("d", "t", "text").join(wanted, ["d", "t"]).mapInArrow(_parts_of(width, part), _PARTS), "suffix-parts")
    core, same = ["suffix", "core", "number"], ["suffix", "core", "number", "low", "high", "hull"]
    cut = cut.withColumn("number", F.floor(F.col("low") / part).cast("int"))
    shape = F.xxhash64("low", "high", "hull")
    groups = cut.groupBy(*core).agg(F.count("*").alias("members"), F.min(shape).alias("least"), F.max(shape).alias("most"))
    held = stage(cut.join(groups.where("members > 1").select(*core, (F.col("least") != F.col("most")).alias("mixed")), core), "suffix-held-parts")
    run = [F.col("d"), F.col("t"), (F.col("place") - F.col("high")).alias("start"), (F.col("high") - F.col("low") + 1).alias("n")]
    alike_parts = held.where("NOT mixed").select(*run)
    mixed = held.where("mixed")
    differing = stage(mixed.groupBy(*same).agg(F.count("*").alias("members"), F.min(F.struct("d", "t", "place", "edges")).alias("one")), "suffix-different-parts")
    whole_parts = mixed.join(differing.where("members > 1").select(*same), same, "left_semi").select(*run)
    # The bytes of a window that are not in the common ones: so many before them, the rest of part - 1 after them.
    o, before = F.col("offset"), F.col("offset") - F.col("number") * part
    left = F.substring("edges", F.col("high") - o + 1, before)
    right = F.substring("edges", F.col("high") - F.col("number") * part + 1, F.lit(part - 1) - before)
    single = differing.select(*same, "members", "one.*", F.explode(F.sequence("low", "high")).alias("offset")).select("suffix", "core", "offset", F.concat(left, right).alias("rest"), "members", "d", "t", "place")
    window = ["suffix", "core", "offset", "rest"]
    repeated = single.groupBy(*window).agg(F.count("*").alias("holders")).where("holders > 1").select(*window)
    one_by_one = single.where("members = 1").join(repeated, window, "left_semi").select("d", "t", (F.col("place") - F.col("offset")).alias("start"), F.lit(1).alias("n"))
    return stage(alike.unionAll(whole).unionAll(alike_parts).unionAll(whole_parts).unionAll(one_by_one), "suffix-runs")


def covered(start: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges that windows cover, merged where they meet; of runs of ``n`` window starts."""
    order = np.argsort(start, kind="stable")
    begin, end = start[order], np.maximum.accumulate((start + n - 1 + width)[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    heads = np.flatnonzero(new)
    return begin[heads], end[np.append(heads[1:], len(begin)) - 1]


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(width: int, with_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, hashes, texts = [], [], [], [], []
            ids = batch["doc_id"]
            runs = batch["runs"]
            for piece in text_slices(batch["text"]):
                for k in range(piece.last - piece.first):
                    data = piece.data[piece.bounds[k] : piece.bounds[k + 1]]
                    row = piece.first + k
                    digest, at, gone, pieces = hashlib.sha256(), 0, 0, []
                    begin = end = ()
                    if runs[row].is_valid:
                        found = runs[row].values
                        begin, end = covered(*(found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n")), width)
                    for lo, hi in zip(begin, end):
                        pieces.append(data[at:lo])
                        at, gone = hi, gone + int(hi - lo)
                    pieces.append(data[at:])
                    for part in pieces:
                        digest.update(part)
                    sizes.append(len(data)), removed.append(gone), spans.append(len(begin)), hashes.append(digest.hexdigest())
                    if with_text:
                        texts.append(b"".join(part.tobytes() for part in pieces))
            columns = [ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.binary())] * with_text, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return rows


def without_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and with ``with_text``
    the remaining bytes as ``kept``.

    Removed is every byte covered by a string of ``width`` bytes (16 or more) that also starts somewhere else, in any row or
    the same one; overlaps count, and nothing crosses rows. Null texts are empty; texts of fewer bytes than ``width`` stay as they
    are. Repeated rows are texts of their own, so all of a repeated long text goes, and a null ``doc_id`` stays
    null. Cuts fall between bytes, so ``kept`` need not be valid UTF-8. Further columns are ignored.
    """
    if width < 2 * _GRAM:
        raise ValueError(f"width must be at least {2 * _GRAM}")
    prepare(docs.sparkSession)
    runs = repeated_windows(docs, width).groupBy("d", "t").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    marked = _texts(docs).join(runs, ["d", "t"], "left").select("doc_id", "text", "runs")
    return marked.mapInArrow(_kept(width, with_text), _KEPT + (", kept binary" if with_text else ""))


#: All windows one by one, as hexadecimal strings.
SQL = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT r, h, unnest(range(CAST(length(h) // 2 - 399 AS BIGINT))) AS p FROM texts WHERE length(h) >= 800),
windows AS (SELECT r, p, md5(substr(h, 2 * p + 1, 800)) AS w FROM starts),
repeated AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
marks AS (SELECT r, p FROM windows SEMI JOIN repeated USING (w)),
heads AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 400 THEN 0 ELSE 1 END AS head FROM marks),
spans AS (SELECT r, g, min(p) AS a, max(p) + 400 AS b FROM (SELECT *, sum(head) OVER (PARTITION BY r ORDER BY p) AS g FROM heads) GROUP BY r, g),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS lo, a AS hi FROM spans UNION ALL SELECT r, max(b), CAST(NULL AS BIGINT) FROM spans GROUP BY r),
kept AS (SELECT r, string_agg(CASE WHEN hi IS NULL THEN substr(h, 2 * lo + 1) ELSE substr(h, 2 * lo + 1, 2 * (hi - lo)) END, '' ORDER BY lo) AS k FROM gaps JOIN texts USING (r) GROUP BY r),
sums AS (SELECT r, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM texts LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""
