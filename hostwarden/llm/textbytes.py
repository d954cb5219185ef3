"""Numpy views of an Arrow text column: slices, words, word hashes and word n-grams.

Everything works on the UTF-8 bytes that Arrow already holds, so a whole batch is tokenised by a few
vector operations instead of a loop over its documents. Slices keep the working memory bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Bytes whose words are hashed at once: hashing takes some 40 bytes of memory a byte.
_HASHED_BYTES = 1 << 17
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_COMBINE = _U(0xD6E8FEB86659FD93)
_COMBINE_INVERSE = pow(int(_COMBINE), -1, 1 << 64)
#: From this length on hashes of runs are differences of sums, which take the same steps for any length.
_LONG_RUN = 6

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}
_run_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _grown(tables: dict[str, np.ndarray], n: int, least: int, base: int, inverse: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a number and of its inverse at least."""
    if len(tables["up"]) < n:
        size = max(least, 1 << (n - 1).bit_length())
        for name, factor in (("up", base), ("down", inverse)):
            table = np.full(size, factor, _U)
            table[0] = 1
            tables[name] = np.cumprod(table, dtype=_U)
    return tables["up"], tables["down"]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _grown(_powers, n, 2 * _HASHED_BYTES, _BASE, _BASE_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of a hash is usable."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of the same values for every salt."""
    return mix(x + _U((salt * 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF))


class Slice(NamedTuple):
    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Runs of whole texts of about ``limit`` bytes; a longer text is a slice of its own, null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = min(n, max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1))
        yield Slice(row, last, data[bounds[row] : bounds[last]], bounds[row : last + 1] - bounds[row])
        row = last


class Words(NamedTuple):
    """Words of a slice in text order: number of the text, first byte, byte after the last, hash."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def edges(solid: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of every run of ``solid`` bytes that stays within one text."""
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    cut = np.zeros(len(solid), bool)
    cut[heads] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | cut[1:]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | cut[1:]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte range, equal for equal bytes wherever they stand."""
    up, down = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start])


def words(piece: Slice, lower: bool = True, solid: np.ndarray | None = None) -> Words:
    """Runs of non-space bytes (or of ``solid`` bytes: a table of 256 flags), A-Z lowered."""
    data = LOWER[piece.data] if lower else piece.data
    start, end = edges(solid[data] if solid is not None else ~SPACE[data], piece.bounds)
    doc = np.searchsorted(piece.bounds[1:], start, "right")
    hashes, lo = np.empty(len(start), _U), 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + _HASHED_BYTES, "right")))
        at = start[lo]
        hashes[lo:hi] = span_hashes(data[at : end[hi - 1]], start[lo:hi] - at, end[lo:hi] - at)
        lo = hi
    return Words(doc, start, end, hashes)


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A number for every ``n`` consecutive hashes, of which there are as many at least; equal runs have equal ones."""
    m = len(hashes) - n + 1
    if n >= _LONG_RUN:
        # The same numbers: n c^n + h[0] c^(n-1) + ... + h[n-1] modulo 2^64, with c the factor below.
        up, down = _grown(_run_powers, len(hashes) + 1, 1 << 12, int(_COMBINE), _COMBINE_INVERSE)
        sums = np.zeros(len(hashes) + 1, _U)
        np.cumsum(hashes * down[: len(hashes)], out=sums[1:])
        total = sums[n:] - sums[:-n]
        total *= up[n - 1 : n - 1 + m]
        total += _U(n * pow(int(_COMBINE), n, 1 << 64) & 0xFFFFFFFFFFFFFFFF)
        return total
    total = np.full(m, n, _U)
    for j in range(n):
        total *= _COMBINE
        total += hashes[j : j + m]
    return total


def ngrams(hashes: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which ``n`` consecutive words of one group begin, and the hashes of these n-grams."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.flatnonzero(group[:m] == group[n - 1 :])
    return at, mix(run_hashes(hashes, n)[at])


def shingle_sets(piece: Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word n-grams of every text of a slice as (text, hash) pairs ordered by text.

    A text of fewer than ``n`` words has its whole word sequence as the only shingle, one without words none.
    """
    w = words(piece)
    at, hashes = ngrams(w.hash, w.doc, n)
    docs = w.doc[at]
    counts = np.bincount(w.doc, minlength=len(piece.bounds) - 1)
    for k in range(1, n):
        if (few := np.isin(w.doc, np.flatnonzero(counts == k))).any():
            own, own_hashes = ngrams(w.hash[few], w.doc[few], k)
            docs, hashes = np.concatenate([docs, w.doc[few][own]]), np.concatenate([hashes, own_hashes])
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    keep = np.ones(len(docs), bool)
    keep[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[keep], hashes[keep]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of consecutive runs of ``values``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
