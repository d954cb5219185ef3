"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

1. Texts are cut into words once; blocks of their hashes are a written table. Which runs of 4 words several texts hold
   is counted in sorted blocks of whole buckets, and every block gets back those of its own runs, so that seeds with
   other runs never leave their task. Every text gives its winnowed word k-mers: any run of ``window + k - 1`` equal words shares one of them.
2. Each seed that several documents hold joins every occurrence with the earliest of these documents, so a seed of a
   third of all documents costs one row for each of them, not their pairs. Pairs whose seeds cover too few words go.
   Where texts are put together from pieces of many others, short seeds point to too many sources; where no
   passage was found around repeated seeds, long seeds follow, winnowed so that every run of 51 equal words has one.
   Its earliest holder shares at least 40 words, enough for a passage.
   What no passage covers then meets the other earlier documents by all its 4-word runs, as a passage of 40 words with
   at most one word in five substituted keeps at least one. Runs that very many texts hold count together with later ones.
3. For the remaining pairs the words around the seeds are fetched, all common k-mers become anchors, and anchors are
   chained in order with gap costs; a Fenwick tree gives the best predecessor of an anchor.
4. The gaps of a chain are aligned word by word, its ends are extended, and chains long and equal enough are passages.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from hostwarden.llm.support import bit_table, maybe_in, packed_bits, positions, prepare, unpacked_bits
from hostwarden.llm.textbytes import lists, ngrams, run_hashes, text_slices, words
from hostwarden.session import release, stage

K, WINDOW = 6, 12
LONG_K = 40
#: Shortest run of equal words that substitutions of one word in five leave in a passage, and the number that any passage of such has.
SHORT_K, SHORT_SHARED = 4, 5
#: Documents up to which all holders of a run of ``SHORT_K`` words meet; runs of more are taken in pairs at these distances in words.
_MANY = 64
_DISTANCES = (4, 8, 16, 32)
#: Runs of words are known by 32 bits and a bucket; there is a bucket for about so many bytes of text, 64 at least
#: and 65,536 at most, which leaves 16 bits for the texts of a block.
_BUCKET_BYTES, _LEAST_BUCKET_BITS, _MOST_BUCKET_BITS = 8 << 20, 6, 16
#: Words of a block of texts, which is sorted at once, and of a row of it; blocks that get back their shared runs together.
_BLOCK_WORDS, _ROW_WORDS, _BLOCKS_A_TASK = 1 << 18, 1 << 16, 8
_CODEC, _FAST = pa.Codec("zstd", 3), pa.Codec("zstd", 1)
#: Small batches of rows, and no shuffle files of tables that are written.
_CONF = {"spark.sql.parquet.columnarReaderBatchSize": "4096", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_SHARED_BITS = 1 << 26
MIN_WORDS, MIN_EQUAL = 40, 0.8
#: Words fetched on either side of the outermost seeds of a pair.
_MARGIN = 64
_GAP_COST, _MAX_GAP, _DROP = 0.5, 48, 6
_MET_FLAGS = 1 << 14


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every window of ``width`` values."""
    out, span = values, 1
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the hashes that are the least of some window of ``width``; all of them if there are fewer."""
    if len(hashes) < width:
        return np.arange(len(hashes))
    low = _sliding(hashes, width, np.minimum)
    pad = np.zeros(width - 1, hashes.dtype)
    return np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), width, np.maximum) == hashes)


def _may_hold(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """``maybe_in`` on the packed bytes of a bit table, which take an eighth of its flags."""
    a, b = positions(keys, 8 * len(packed))
    return ((packed[a >> 3] << (a & 7).astype(np.uint8)) & (packed[b >> 3] << (b & 7).astype(np.uint8)) & np.uint8(128)) > 0


class Block(NamedTuple):
    """Texts of a block: ids, words of each, texts of each slice they were read in; text and hash of every word."""

    ids: np.ndarray
    counts: np.ndarray
    slices: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, int]]:
    """Blocks of the texts of a task, and their bytes."""
    held, n_words, n_texts, n_bytes = [], 0, 0, 0

    def block() -> Block:
        ids, counts, hashes = zip(*held)
        slices, counts = np.array([len(x) for x in ids], np.int32), np.concatenate(counts)
        return Block(np.concatenate(ids), counts, slices, np.repeat(np.arange(len(counts)), counts), np.concatenate(hashes))

    for batch in batches:
        ids = batch["doc_id"].to_numpy(zero_copy_only=False)
        for piece in text_slices(batch["text"]):
            n = piece.last - piece.first
            if held and (n_words >= _BLOCK_WORDS or n_texts + n > 1 << 32 - _MOST_BUCKET_BITS):
                yield block(), n_bytes
                held, n_words, n_texts, n_bytes = [], 0, 0, 0
            w = words(piece)
            held.append((ids[piece.first : piece.last], np.bincount(w.doc, minlength=n).astype(np.int32), w.hash))
            n_words, n_texts, n_bytes = n_words + len(w.hash), n_texts + n, n_bytes + len(piece.data)
    if held:
        yield block(), n_bytes


_BLOCKS = "block long, part int, ids binary, counts binary, slices binary, words binary, bytes long, longest long, low long, high long"
#: Tables of packed rows, some 0.3 MB each: pages of few rows, read a few rows at once.
_FEW_ROWS = {"compression": "uncompressed", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
_WORDS = ["block", "part", "ids", "counts", "slices", "words"]


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole texts: a block takes several, as the JVM handles rows of half a megabyte badly."""
    first = TaskContext.get().partitionId() << 32
    for number, (b, n_bytes) in enumerate(_gathered(batches)):
        ends, lo = np.cumsum(b.counts), 0
        for part in range(len(ends)):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _ROW_WORDS, "right")))
            ids, counts, hashes = b.ids[lo:hi], b.counts[lo:hi], b.hash[ends[lo] - b.counts[lo] : ends[hi - 1]]
            row = {"block": first + number, "part": part, "ids": ids.tobytes(), "counts": counts.tobytes(), "slices": b.slices.tobytes(), "words": _CODEC.compress(hashes.tobytes(), asbytes=True)}
            row |= {"bytes": 0 if part else n_bytes, "longest": int(counts.max()), "low": int(ids.min()), "high": int(ids.max())}
            kinds = {"part": pa.int32()}
            yield pa.RecordBatch.from_pydict({name: pa.array([x], pa.binary() if isinstance(x, bytes) else kinds.get(name, pa.int64())) for name, x in row.items()})
            if (lo := hi) == len(ends):
                break


def _unpacked(parts: list[tuple[bytes, ...]]) -> Block:
    """A block of its rows in their order."""
    ids, counts, slices, hashes = zip(*parts)
    counts = [np.frombuffer(n, np.int32) for n in counts]
    hashes = [np.frombuffer(_CODEC.decompress(x, 8 * int(n.sum()), asbytes=True) if n.any() else b"", np.uint64) for n, x in zip(counts, hashes)]
    n = np.concatenate(counts)
    return Block(np.concatenate([np.frombuffer(x, np.int64) for x in ids]), n, np.frombuffer(slices[0], np.int32), np.repeat(np.arange(len(n)), n), np.concatenate(hashes))


def _stored(batches: Iterator[pa.RecordBatch], whole: bool = True) -> Iterator[tuple[int, Block]]:
    """Blocks of the written table with their numbers; without ``whole`` their rows as blocks. A block may come in two if a
    file is read by two tasks."""
    held, last = [], None
    for batch in batches:
        for row in range(len(batch)):
            number, *blobs = (batch[c][row].as_py() for c in ("block", "ids", "counts", "slices", "words"))
            if held and (number != last or not whole):
                yield last, _unpacked(held)
                held = []
            held.append(blobs)
            last = number
    if held:
        yield last, _unpacked(held)


def _classes(ids: np.ndarray, low: int, width: int) -> np.ndarray:
    """The class of every id, one of 256."""
    return np.clip((ids.astype(np.float64) - float(low)) / width * 256, 0, 255).astype(np.uint8)


def _run_key(hashes: np.ndarray, bits: int) -> np.ndarray:
    """What is kept of the hash of a run: its first bits, which are its bucket, and 32 more."""
    return (hashes >> np.uint64(32 - bits)).view(np.int64)


def _run_blocks(bits: int, low: int, width: int, stored: bool = False):
    """Runs of ``SHORT_K`` words of all texts, or of the ``stored`` blocks of texts, once for each block: blobs of one bucket
    each, with the number of holders, the least of 256 classes of ids among them, and whether several holders are in that class."""

    room = 32 - bits  # bits left for the number of a text in its block

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in _stored(batches) if stored else ((None, b) for b, _ in _gathered(batches)):
            at, hashes = ngrams(b.hash, b.doc, SHORT_K)
            if not len(at):
                continue
            both = np.sort(((hashes >> np.uint64(room)) << np.uint64(room)) | b.doc[at].astype(np.uint64))
            both = both[np.concatenate([[True], both[1:] != both[:-1]])]
            key, group = (both >> np.uint64(room)).view(np.int64), _classes(b.ids, low, width)[both & np.uint64((1 << room) - 1)]
            key, n, least, several = _merged(key, np.ones(len(key), np.uint8), group, np.zeros(len(key), bool))
            buckets = np.arange(1 << bits)
            cut = np.searchsorted(key, np.append(buckets, 1 << bits) << 32)
            some = np.flatnonzero(cut[1:] > cut[:-1])
            columns = (key & 0xFFFFFFFF).astype(np.uint32), np.minimum(n, 255).astype(np.uint8), least, several
            blobs = [pa.array([c[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary()) for c in columns]
            names = ["bucket", "runs", "n", "least", "several"]
            numbers = [pa.array(np.full(len(some), number))] if stored else []
            yield pa.RecordBatch.from_arrays([*numbers, pa.array(some.astype(np.int32)), *blobs], ["block", *names] if stored else names)

    return rows


def _merged(key: np.ndarray, n: np.ndarray, least: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of sorted keys joined to one row a key: summed holders, least class, whether that class has several holders."""
    if not len(key):
        return key, n, least, several
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    low = np.minimum.reduceat(least, head)
    in_low = least == np.repeat(low, np.diff(np.append(head, len(key))))
    return key[head], np.add.reduceat(n, head, dtype=np.int64), low, np.add.reduceat(in_low * (1 + several.astype(np.uint8)), head, dtype=np.int64) > 1


def _of_buckets(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """Every whole bucket of a task: its number, the columns ``more`` and the runs of each blob, in order of the blobs; for
    each run the place of its joined row, and these rows."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for bucket, *values in zip(*(batch[c].to_pylist() for c in ("bucket", "runs", "n", "least", "several", *more))):
            blobs = (np.frombuffer(x, kind) for x, kind in zip(values, (np.uint32, np.uint8, np.uint8, bool)))
            held.setdefault(bucket, []).append((*blobs, *values[4:]))
    for bucket in list(held):
        runs, n, least, several, *rest = zip(*held.pop(bucket))
        key = np.concatenate(runs)
        # Whole numbers sort much faster than their places do.
        both = np.sort((key.astype(np.uint64) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64))
        key, order = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        place = np.empty(len(key), np.int32)
        place[order] = np.cumsum(np.append(False, key[1:] != key[:-1]))
        yield bucket, rest, runs, place, _merged(key, *(np.concatenate(x)[order] for x in (n, least, several)))


def _shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that several texts hold, of whole buckets."""
    for bucket, _, _, _, (key, n, least, several) in _of_buckets(batches):
        some = n > 1
        yield pa.RecordBatch.from_arrays([
            pa.array(key[some].astype(np.int64) | (bucket << 32)), pa.array(n[some]), pa.array(least[some].astype(np.int32)), pa.array(several[some]),
        ], ["seed", "n", "least", "several"])


_SHARED = "block long, bucket int, runs binary"
_RUN = np.dtype([("run", np.uint32), ("least", np.uint8), ("flags", np.uint8)])


def _shared_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every block those of its runs that several texts hold: least class of ids, and flags for several in that class (1) and very many holders (2)."""
    for bucket, (blocks,), runs, place, (_, n, least, several) in _of_buckets(batches, "block"):
        flags = several + 2 * (n > _MANY).astype(np.uint8)
        kept = np.flatnonzero((n > 1)[place])
        cut = np.searchsorted(kept, np.cumsum([0, *map(len, runs)]))
        found = np.empty(len(kept), _RUN)
        found["run"], found["least"], found["flags"] = np.concatenate(runs)[kept], least[place[kept]], flags[place[kept]]
        some = np.flatnonzero(cut[1:] > cut[:-1])
        blobs = pa.array([_packed(found[cut[k] : cut[k + 1]]) for k in some], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([blocks[k] for k in some], pa.int64()), pa.array(np.full(len(some), bucket, np.int32)), blobs], ["block", "bucket", "runs"])


_FOUND = {"seed": np.int64, "doc": np.int32, "pos": np.int32}, {"seed": np.int64, "doc": np.int32, "lo": np.int32, "span": np.int32, "flags": np.uint8}
_MARKED = ", ".join(["ids binary", *(f"{name}_{c} binary" for name, kinds in (("short", _FOUND[0]), ("long", _FOUND[0]), ("run", _FOUND[1])) for c in kinds)])


def _packed(values: np.ndarray) -> bytes:
    """Their number and their bytes, the first ones of all before the second ones."""
    return len(values).to_bytes(8) + _FAST.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T), asbytes=True) if len(values) else b""


def _array(blob: bytes, kind: type | np.dtype) -> np.ndarray:
    width, n = np.dtype(kind).itemsize, int.from_bytes(blob[:8])
    raw = _FAST.decompress(blob[8:], width * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def _marked(bits: int, low: int, width: int):
    """What the blocks and their shared runs give: a row for each block with its seeds of ``K`` and of ``LONG_K`` words that have
    only shared runs, and each text's shared runs with first and last position and flags for an earlier holder (1) and very many holders (2)."""

    def seeds(b: Block, before: np.ndarray, first_word: np.ndarray, k: int) -> list[np.ndarray]:
        out, lo = [], 0
        for hi in np.cumsum(b.counts)[np.cumsum(b.slices) - 1]:
            at, hashes = ngrams(b.hash[lo:hi], b.doc[lo:hi], k)
            chosen = winnow(hashes, WINDOW)
            at, hashes = at[chosen] + lo, hashes[chosen]
            some = before[at + k - SHORT_K + 1] - before[at] == k - SHORT_K + 1
            doc = b.doc[at[some]]
            out.append((hashes[some].view(np.int64), doc, at[some] - first_word[doc]))
            lo = hi
        return [np.concatenate(x) for x in zip(*out)]

    def runs(b: Block, at: np.ndarray, key: np.ndarray, flags: np.ndarray, first_word: np.ndarray) -> tuple[np.ndarray, ...]:
        # Keys have 48 bits and blocks no more than 2^16 texts; equal keys stay in text order.
        order = np.argsort((b.doc[at].astype(np.uint64) << np.uint64(48)) | key.view(np.uint64), kind="stable")
        at, key = at[order], key[order]
        doc = b.doc[at]
        new = np.ones(len(at) + 1, bool)
        new[1:-1] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        head, tail = np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])
        doc = doc[head]
        return key[head], doc, at[head] - first_word[doc], at[tail] - at[head], flags[order][head]

    def row(b: Block, found: list[tuple]) -> pa.RecordBatch:
        first_word = np.cumsum(b.counts) - b.counts
        at, hashes = ngrams(b.hash, b.doc, SHORT_K)
        key = _run_key(hashes, bits)
        shared, least, flags = np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        if found := sorted(found, key=lambda x: x[0]):
            parts = [(bucket, _array(x, _RUN)) for bucket, x in found]
            shared = np.concatenate([x["run"].astype(np.int64) | (bucket << 32) for bucket, x in parts])
            least, flags = (np.concatenate([x[c] for _, x in parts]) for c in ("least", "flags"))
            if (shared[1:] <= shared[:-1]).any():  # of a block that came in two
                shared, first = np.unique(shared, return_index=True)
                least, flags = least[first], flags[first]
        maybe = np.zeros(1 << 20, bool)  # most are not shared, and this tells so faster than a search
        maybe[shared & (len(maybe) - 1)] = True
        some = np.flatnonzero(maybe[key & (len(maybe) - 1)])
        at, key = at[some], key[some]
        place = np.searchsorted(shared, key)
        some = np.flatnonzero(np.append(shared, -1)[place] == key)
        at, key, place = at[some], key[some], place[some]
        earlier = (_classes(b.ids, low, width)[b.doc[at]] > least[place]) | (flags[place] & 1 > 0)
        is_shared = np.zeros(len(b.hash) + 1, np.int32)
        is_shared[at + 1] = 1
        before = np.cumsum(is_shared)
        columns = [seeds(b, before, first_word, K), seeds(b, before, first_word, LONG_K), runs(b, at, key, earlier + (flags[place] & 2), first_word)]
        blobs = [_packed(x.astype(kind)) for part, kinds in zip(columns, (_FOUND[0], _FOUND[0], _FOUND[1])) for x, kind in zip(part, kinds.values())]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (b.ids.tobytes(), *blobs)], [c.split()[0] for c in _MARKED.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, list[tuple]] = {}
        found: dict[int, list[tuple]] = {}
        for batch in batches:
            for block, bucket, part, runs, *blobs in zip(*(batch[c].to_pylist() for c in ("block", "bucket", "part", "runs", *_WORDS[2:]))):
                if bucket is None:
                    texts.setdefault(block, []).append((part, blobs))
                else:
                    found.setdefault(block, []).append((bucket, runs))
        for block in list(texts):
            yield row(_unpacked([blobs for _, blobs in sorted(texts.pop(block))]), found.pop(block, []))

    return rows


def _parts(batches: Iterator[pa.RecordBatch], name: str, kinds: dict) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids of each row of ``_MARKED`` and its columns that begin with ``name``."""
    for batch in batches:
        for ids, *blobs in zip(*(batch[c].to_pylist() for c in ("ids", *(f"{name}_{c}" for c in kinds)))):
            yield np.frombuffer(ids, np.int64), *(_array(x, kind) for x, kind in zip(blobs, kinds.values()))


def _seeds(name: str, wanted=None):
    """Seeds of every text, or of those whose id may be in the bit table ``wanted``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = unpacked_bits(wanted.value) if wanted is not None else None
        for ids, seed, doc, pos in _parts(batches, name, _FOUND[0]):
            if flags is not None:
                some = maybe_in(flags, ids)[doc]
                seed, doc, pos = seed[some], doc[some], pos[some]
            yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(ids[doc]), pa.array(pos)], ["seed", "doc_id", "pos"])

    return rows


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of every text that may have earlier holders: one row a text with lists."""
    for ids, seed, doc, lo, span, flags in _parts(batches, "run", _FOUND[1]):
        some = np.flatnonzero(flags & 1)
        counts = np.bincount(doc[some], minlength=len(ids))
        held = np.flatnonzero(counts)
        values = [lists(x[some], counts[held], kind) for x, kind in ((seed, pa.int64()), (lo, pa.int32()), (lo + span, pa.int32()), (flags > 1, pa.bool_()))]
        yield pa.RecordBatch.from_arrays([pa.array(ids[held]), *values], ["doc_id", "seeds", "lo", "hi", "hot"])


def _holders(needed):
    """Runs of every text that may be in the bit table ``needed``, one row each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(needed.value, np.uint8)
        for ids, seed, doc, lo, span, _ in _parts(batches, "run", _FOUND[1]):
            some = _may_hold(table, seed)
            yield pa.RecordBatch.from_arrays([pa.array(seed[some]), pa.array(ids[doc[some]]), pa.array(lo[some]), pa.array((lo + span)[some])], ["seed", "doc_id", "lo", "hi"])

    return rows


def _open_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for every run of a text that is not inside one of its passages."""
    for batch in batches:
        counts = np.diff(batch["seeds"].offsets.to_numpy())
        doc = np.repeat(np.arange(len(batch)), counts)
        columns = [batch[c].flatten() for c in ("seeds", "lo", "hi", "hot")]
        lo, hi = (columns[k].to_numpy() for k in (1, 2))
        inside, start = np.zeros(len(doc), bool), np.cumsum(counts) - counts
        for row, spans in enumerate(batch["spans"].to_pylist()):
            own = slice(start[row], start[row] + counts[row])
            for span in spans or ():
                inside[own] |= (span["s"] <= lo[own]) & (hi[own] + SHORT_K <= span["e"])
        left = pa.array(np.flatnonzero(~inside))
        seeds, lo, hi, hot = (x.take(left) for x in columns)
        yield pa.RecordBatch.from_arrays([seeds, batch["doc_id"].take(pa.array(doc).take(left)), lo, hi, hot], ["seed", "doc_id", "lo", "hi", "hot"])


def _word_rows(wanted):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = unpacked_bits(wanted.value)
        for _, b in _stored(batches, False):
            some = maybe_in(flags, b.ids)
            if some.any():
                values, last = b.hash[some[b.doc]].astype(np.uint32), np.cumsum(np.append(0, b.counts[some]))
                words_ = pa.Array.from_buffers(pa.binary(), len(last) - 1, [None, pa.py_buffer((4 * last).astype(np.int32)), pa.py_buffer(values)])
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[some]), words_], ["doc_id", "words"])

    return rows


def _nth(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the values, and for each in that order how many equal ones stand before it."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0))
    return order, np.arange(len(ranked)) - start


def _met(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions of equal k-mers: each one of ``a`` meets one of ``b``, the nth the nth; where ``b`` has fewer, it starts
    again from its first. And whether those that meet recur in neither."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), True
    if min(len(a), len(b)) < k:
        return nothing
    ha, hb = (run_hashes(seq.view(np.uint32).astype(np.uint64), k) for seq in (a, b))
    # Most k-mers of most pairs meet none; only those that may are sorted.
    low_a, low_b = ((h & np.uint64(_MET_FLAGS - 1)).view(np.int64) for h in (ha, hb))
    flags = np.zeros(_MET_FLAGS, bool)
    flags[low_a] = True
    at_b = flags[low_b].nonzero()[0]
    if not len(at_b):
        return nothing
    flags[:] = False
    flags[low_b[at_b]] = True
    at_a = flags[low_a].nonzero()[0]
    ha, hb = ha[at_a], hb[at_b]
    ob = hb.argsort(kind="stable")
    hb = hb[ob]
    lo = hb.searchsorted(ha)
    lo[lo == len(hb)] = 0
    met = (hb[lo] == ha).nonzero()[0]
    if not (hb[1:] == hb[:-1]).any():
        j = at_b[ob[lo[met]]]
        return at_a[met], j, not len(j) or np.bincount(j).max() == 1
    order, nth = _nth(ha[met])
    i = met[order]
    lo, hi = lo[i], hb.searchsorted(ha[i], "right")
    return at_a[i], at_b[ob[lo + nth % (hi - lo)]], False


def anchors(a: np.ndarray, b: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """Maximal runs ``(start in a, start in b, words)`` of common k-mers. Where short ones recur, long ones tell which belong together."""
    i, j, single = _met(a, b, k)
    if not len(i):
        return []
    if not single and len(i) > LONG_K - k:
        # A common run of LONG_K words is so many met k-mers in a row; without these it isn't looked for.
        missing = np.flatnonzero(np.bincount(i, minlength=len(a)) == 0)
        if np.diff(missing, prepend=-1, append=len(a)).max() - 1 > LONG_K - k:
            far_i, far_j, _ = _met(a, b, LONG_K)
            within = np.arange(LONG_K - k + 1)
            i, j = (np.concatenate([x, (far[:, None] + within).ravel()]) for x, far in ((i, far_i), (j, far_j)))
    # One whole number for each pair of positions, by diagonals: numbers sort much faster than pairs.
    both = (i - j + len(b)) * len(a) + i
    both.sort()
    if not single:
        both = both[np.append(True, both[1:] != both[:-1])]
    diagonal, i = np.divmod(both, len(a))
    heads = np.append(0, (both[1:] != both[:-1] + 1).nonzero()[0] + 1)
    # Numbers that follow each other are on one diagonal, as the last position of ``a`` begins no k-mer.
    n = np.diff(heads, append=len(both)) + k - 1
    i = i[heads]
    return sorted(zip(i.tolist(), (i - diagonal[heads] + len(b)).tolist(), n.tolist()))


class MaxTree:
    """Fenwick tree for the largest (value, item) of a prefix."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, at: int, value: float, item: int) -> None:
        at += 1
        while at < len(self.best):
            if self.best[at][0] < value:
                self.best[at] = (value, item)
            at += at & -at

    def top(self, before: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        while before > 0:
            if self.best[before][0] > found[0]:
                found = self.best[before]
            before -= before & -before
        return found


def chains(runs: list[tuple[int, int, int]], k: int = K) -> list[list[tuple[int, int, int]]]:
    """Ordered runs chained so that words minus gap costs are greatest; each run is in one chain, best chains first."""
    ends = sorted({j + n - k + 1 for _, j, n in runs})
    rank = {e: r for r, e in enumerate(ends)}
    tree, score, back = MaxTree(len(ends)), [0.0] * len(runs), [-1] * len(runs)
    by_end = sorted(range(len(runs)), key=lambda r: runs[r][0] + runs[r][2])
    ready = 0
    for r, (i, j, n) in enumerate(runs):
        # A predecessor ends before this run in both texts, up to k - 1 shared words at an edit.
        while ready < len(by_end) and runs[by_end[ready]][0] + runs[by_end[ready]][2] - k + 1 <= i:
            p = by_end[ready]
            if p >= r:
                break
            tree.put(rank[runs[p][1] + runs[p][2] - k + 1], score[p] + _GAP_COST * (sum(runs[p]) + runs[p][2]), p)
            ready += 1
        value, p = tree.top(bisect_right(ends, j))
        value -= _GAP_COST * (i + j)
        score[r], back[r] = (n + value, p) if value > 0 else (float(n), -1)
    used, out = set(), []
    for r in sorted(range(len(runs)), key=lambda r: -score[r]):
        chain = []
        while r >= 0 and r not in used:
            chain.append(runs[r])
            used.add(r)
            r = back[r]
        if chain:
            out.append(chain[::-1])
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words of the longest common subsequence of two short gaps."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        step = np.maximum(row[1:], row[:-1] + (b == x))
        row[1:] = np.maximum.accumulate(step)
    return int(row[-1])


def _extended(a: np.ndarray, b: np.ndarray, i: int, j: int, step: int) -> tuple[int, int]:
    """Words by which an end can be moved over single substitutions, and how many of them are equal."""
    n = min(len(a) - i, len(b) - j) if step > 0 else min(i, j)
    n = min(n, 4 * _MARGIN)
    if n <= 0:
        return 0, 0
    same = a[i : i + n] == b[j : j + n] if step > 0 else (a[i - n : i] == b[j - n : j])[::-1]
    total = np.cumsum(np.where(same, 1, -2))
    fall = np.flatnonzero(np.maximum.accumulate(total) - total > _DROP)
    reach = int(fall[0]) if len(fall) else n
    if not reach or total[:reach].max() <= 0:
        return 0, 0
    best = int(total[:reach].argmax()) + 1
    return best, int(same[:best].sum())


def _filled(a: np.ndarray, b: np.ndarray, s: int, e: int, t: int, f: int, words: int) -> tuple[int, int, int]:
    """``words`` more on the diagonals of both ends, where most are equal: words before, words after, equal ones."""
    before, after = min(words, s, t), min(words, len(a) - e, len(b) - f)
    head = np.concatenate([[0], np.cumsum((a[s - before : s] == b[t - before : t])[::-1])])
    tail = np.concatenate([[0], np.cumsum(a[e : e + after] == b[f : f + after])])
    if before + after < words:
        return 0, 0, 0
    x = np.arange(words - after, before + 1)
    same = head[x] + tail[words - x]
    best = int(same.argmax())
    return int(x[best]), words - int(x[best]), int(same[best])


def passages(a: np.ndarray, b: np.ndarray, min_words: int = MIN_WORDS, min_equal: float = MIN_EQUAL, k: int = K) -> list[tuple[int, int, int, int, int]]:
    """Fuzzy common passages of two word sequences: ``(start a, end a, start b, end b, equal words)``."""
    if len(a) == len(b) and len(a) >= max(min_words, k) and np.array_equal(a, b):
        return [(0, len(a), 0, len(b), len(a))]
    runs = anchors(a, b, k)
    out, taken = [], np.zeros(len(a), bool)

    def report(pieces: list[list[int]], gaps: list[tuple[int, int]]) -> None:
        """The whole chain if it is equal enough, or else its parts on either side of its widest gap."""
        s, t, e, f = pieces[0][0], pieces[0][1], pieces[-1][0] + pieces[-1][2], pieces[-1][1] + pieces[-1][2]
        equal = sum(n for *_, n in pieces) + sum(same for _, same in gaps)
        before, same_before = _extended(a, b, s, t, -1)
        after, same_after = _extended(a, b, e, f, 1)
        s, t, e, f, equal = s - before, t - before, e + after, f + after, equal + same_before + same_after
        if (short := min_words - min(e - s, f - t)) > 0:  # changed words near the ends
            before, after, same = _filled(a, b, s, e, t, f, short)
            s, t, e, f, equal = s - before, t - before, e + after, f + after, equal + same
        if max((width for width, _ in gaps), default=0) <= _MAX_GAP and min(e - s, f - t) >= min_words and equal >= min_equal * max(e - s, f - t):
            if 2 * taken[s:e].sum() < e - s:  # else a better passage of this pair has these words
                taken[s:e] = True
                out.append((s, e, t, f, equal))
        elif gaps:
            cut = max(range(len(gaps)), key=lambda g: gaps[g][0])
            todo.extend([(pieces[: cut + 1], gaps[:cut]), (pieces[cut + 1 :], gaps[cut + 1 :])])

    for chain in chains(runs, k) if runs else ():
        pieces, gaps = [], []
        for i, j, n in chain:
            if pieces:
                end_a, end_b = pieces[-1][0] + pieces[-1][2], pieces[-1][1] + pieces[-1][2]
                over = max(0, end_a - i, end_b - j)
                i, j, n = i + over, j + over, n - over
                if n <= 0:
                    continue
                width = max(i - end_a, j - end_b)
                gaps.append((width, _common(a[end_a:i], b[end_b:j]) if width <= _MAX_GAP and i > end_a and j > end_b else 0))
            pieces.append([i, j, n])
        todo = [(pieces, gaps)]
        while todo:
            report(*todo.pop())
    return sorted(out)


_PASSAGES = "doc_id long, source_id long, start_word int, end_word int, source_start int, source_end int, equal_words int"


def _aligned(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            pairs = zip(*(batch[c].to_pylist() for c in ("doc_id", "source_id", "lo", "source_lo", "words", "source_words")))
            for doc, source, lo, source_lo, mine, theirs in pairs:
                for s, e, t, f, equal in passages(*(np.frombuffer(x, np.int32) for x in (mine, theirs)), k=k):
                    found.append((doc, source, lo + s, lo + e, source_lo + t, source_lo + f, equal))
            columns = list(zip(*found)) or [[]] * 7
            kinds = [pa.int64()] * 2 + [pa.int32()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "source_id", "start_word", "end_word", "source_start", "source_end", "equal_words"])

    return rows


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of ``docs(doc_id, text)`` that an earlier document (of smaller id) has too, one row each:
    ``doc_id, source_id, start_word, end_word`` (exclusive) ``, source_start, source_end, equal_words``.

    A passage has 40 words or more on both sides, four fifths of them equal in order; words are runs of characters
    other than white space, A-Z lowered. Its source is the earliest document that holds a seed of it or, where that one has
    no such passage, any earlier one, and there may be several. Words that more than 64 texts share count in pairs of
    runs up to 32 words apart; of pairs that more than 64 texts share each text is compared with the one before that has
    them too, so a fuzzy passage can be missed where all such pairs of it are as common. Every run of 51 equal words that an earlier document has is covered but for a few words at its ends.
    Rows without id or text and texts of fewer than 40 words have no passages. Of rows that share an id only one is
    compared with each source, and never with one another. Further columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    before = {key: spark.conf.get(key, None) for key in _CONF}
    for key, value in _CONF.items():
        spark.conf.set(key, value)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND length(text) > 0")

    blocks = stage(texts.mapInArrow(_text_blocks, _BLOCKS), "passage-words", _FEW_ROWS)
    size = blocks.agg(F.count_if(F.col("part") == 0).alias("n"), F.sum("bytes").alias("bytes"), F.max("longest").alias("longest"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    low, width = size["low"] or 0, (size["high"] or 0) - (size["low"] or 0) + 1
    bits = min(_MOST_BUCKET_BITS, max(_LEAST_BUCKET_BITS, ((size["bytes"] or 0) // _BUCKET_BYTES).bit_length()))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "4")
    runs = blocks.select(*_WORDS).mapInArrow(_run_blocks(bits, low, width, True), "block long, bucket int, runs binary, n binary, least binary, several binary")
    shared = stage(runs.repartition(1 << bits, "bucket").mapInArrow(_shared_of_blocks, _SHARED).coalesce(1 << bits - 2), "passage-shared")
    both = blocks.select(*_WORDS).unionByName(shared, allowMissingColumns=True)
    marked = stage(both.repartition(1 + size["n"] // _BLOCKS_A_TASK, "block").mapInArrow(_marked(bits, low, width), _MARKED), "passage-seeds", _FEW_ROWS)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", _CONF["spark.sql.parquet.columnarReaderBatchSize"])
    release(shared)

    # Id and position as one number, which is aggregated without sorting rows; ids may be too far apart for 63 bits.
    step = (size["longest"] or 0) + 1
    kind, base = ("long", low) if width * step < 1 << 63 else ("decimal(38,0)", 0)
    place = (F.col("doc_id").cast(kind) - F.lit(base)) * F.lit(step) + F.col("pos")

    def place_id(column: str):
        return F.expr(f"({column} - pmod({column}, {step})) div {step}") + F.lit(base)

    def of(name: str, kinds: dict, rows, schema: str) -> DataFrame:
        return marked.select("ids", *(f"{name}_{c}" for c in kinds)).mapInArrow(rows, schema)

    def hits(name: str, wanted=None) -> tuple[DataFrame, DataFrame]:
        """Seeds that several documents hold, with the earliest of them; and the written table of these."""
        seeds = of(name, _FOUND[0], _seeds(name, wanted), "seed long, doc_id long, pos int")
        ends = seeds.groupBy("seed").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(place_id("first") != place_id("last"))
        earliest = stage(ends.select("seed", place_id("first").alias("source_id"), F.expr(f"pmod(first, {step})").cast("int").alias("source_pos")), "passage-sources")
        return seeds.join(earliest, "seed"), earliest

    def spans(found: DataFrame, k: int) -> DataFrame:
        """For every document and source: the number of seeds, and the words they cover in both."""
        low = [F.min(c).alias(f"min_{c}") for c in ("pos", "source_pos")]
        high = [(F.max(c) + k).alias(f"end_{c}") for c in ("pos", "source_pos")]
        return found.groupBy("doc_id", "source_id").agg(F.count(F.lit(1)).alias("seeds"), *low, *high)

    met, earliest = hits("short")
    short = stage(spans(met, K), "passage-spans")
    release(earliest)
    repeats = short.groupBy("doc_id").agg(F.sum("seeds").alias("n")).where("n > 2")
    wanted = spark.sparkContext.broadcast(packed_bits(bit_table(repeats, "doc_id")))
    first = _passages_of(blocks, stage(short.where(f"seeds > 1 AND end_pos - min_pos >= {8 + K} AND doc_id <> source_id"), "passage-pairs"))
    # Long seeds only look for what no passage covers yet.
    covered = stage(first.groupBy("doc_id").agg(F.collect_set(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"))).alias("spans")), "passage-covered")
    met, earliest = hits("long", wanted)
    left = met.where("doc_id <> source_id").join(covered, "doc_id", "left")
    inside = F.exists("spans", lambda x: (x["s"] <= F.col("pos")) & (F.col("pos") + LONG_K <= x["e"]))
    more = stage(spans(left.where(~F.coalesce(inside, F.lit(False))), LONG_K), "passage-pairs")
    release(earliest, short)
    found = first.unionByName(_passages_of(blocks, more))
    asked = of("run", _FOUND[1], _asked, "doc_id long, seeds array<long>, lo array<int>, hi array<int>, hot array<boolean>")
    pairs = _short_pairs(asked, lambda needed: of("run", _FOUND[1], _holders(needed), "seed long, doc_id long, lo int, hi int"), found)
    release(marked)
    found = found.unionByName(_passages_of(blocks, pairs, SHORT_K))
    release(blocks)
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return found.distinct()


def _table_bits(keys: int) -> int:
    """Sixteen bits a key, a power of two, and ``_SHARED_BITS`` at most."""
    return min(_SHARED_BITS, 1 << max(16, (16 * keys).bit_length()))


def _short_pairs(texts: DataFrame, holders_of, found: DataFrame) -> DataFrame:
    """Pairs of documents with enough common runs of ``SHORT_K`` words outside the passages ``found`` of the later one; a written table.

    ``texts`` has the runs of every text that may have earlier holders, ``holders_of`` gives the holders of the runs of a bit table.
    """
    spark = texts.sparkSession
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"))).alias("spans"))
    asked = stage(texts.join(spans, "doc_id", "left").mapInArrow(_open_runs, "seed long, doc_id long, lo int, hi int, hot boolean"), "passage-open")
    last = stage(asked.groupBy("seed").agg(F.max("doc_id").alias("last"), F.max("hot").alias("hot")), "passage-asked")
    needed = spark.sparkContext.broadcast(packed_bits(bit_table(last, "seed", _table_bits(last.count()))))
    sources = holders_of(needed).join(last, "seed").where("doc_id <= last")
    both = sources.select("seed", "hot", "doc_id", "lo", "hi", F.lit(False).alias("open")).unionByName(asked.withColumn("open", F.lit(True)))
    holders = both.groupBy("seed", "doc_id").agg(F.max("hot").alias("hot"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or("open").alias("open"))
    holders = stage(holders, "passage-holders")
    release(asked, last)

    def met(rows: DataFrame) -> DataFrame:
        source = rows.select("seed", F.col("doc_id").alias("source_id"), F.col("lo").alias("source_lo"), F.col("hi").alias("source_hi"))
        return rows.where("open").drop("open").join(source, "seed").where("source_id < doc_id")

    # A run of very many texts counts with the next such runs at several distances; of pairs that are as common, each holder meets the one before.
    ahead = Window.partitionBy("doc_id").orderBy("lo")
    follows = [F.first(F.struct("seed", "lo", "hi")).over(ahead.rangeBetween(d, MIN_WORDS - SHORT_K)) for d in _DISTANCES]
    hot = holders.where("hot").select("*", F.array_distinct(F.array(*follows)).alias("follows")).withColumn("then", F.explode("follows")).where("then IS NOT NULL")
    hot = hot.select(F.xxhash64("seed", "then.seed").alias("seed"), "doc_id", "lo", F.greatest("hi", "then.hi").alias("hi"), "open")
    hot = stage(hot.groupBy("seed", "doc_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or("open").alias("open")), "passage-hot")
    counts = hot.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    hot = stage(hot.join(counts, "seed").where("n > 1"), "passage-hot-counted")
    # The holder before is in the same chunk of ids, or the last one of the chunk before.
    chain = hot.where(f"n > {_MANY}").withColumn("chunk", F.expr(f"doc_id div {1 << 16}"))
    holder = F.struct("doc_id", "lo", "hi")
    tails = chain.groupBy("seed", "chunk").agg(F.max(holder).alias("tail"))
    carried = tails.select("seed", "chunk", F.lag("tail").over(Window.partitionBy("seed").orderBy("chunk")).alias("carried"))
    chain = chain.select("*", F.lag(holder).over(Window.partitionBy("seed", "chunk").orderBy("doc_id")).alias("near")).join(carried, ["seed", "chunk"])
    links = chain.withColumn("before", F.coalesce("near", "carried")).where("open AND before IS NOT NULL")
    links = links.select("doc_id", F.col("before.doc_id").alias("source_id"), "lo", "hi", F.col("before.lo").alias("source_lo"), F.col("before.hi").alias("source_hi"))
    columns = ["doc_id", "source_id", "lo", "hi", "source_lo", "source_hi"]
    single = met(holders.where("NOT hot").drop("hot")).select(*columns, F.lit(1).alias("seeds"))
    double = met(hot.where(f"n <= {_MANY}").drop("n")).select(*columns, F.lit(2).alias("seeds"))
    pairs = single.unionByName(double).unionByName(links.select(*columns, F.lit(2).alias("seeds"))).groupBy("doc_id", "source_id")
    ends = [F.min("lo").alias("min_pos"), F.min("source_lo").alias("min_source_pos"), (F.max("hi") + SHORT_K).alias("end_pos"), (F.max("source_hi") + SHORT_K).alias("end_source_pos")]
    pairs = stage(pairs.agg(F.sum("seeds").alias("seeds"), *ends).where(f"seeds >= {SHORT_SHARED}"), "passage-pairs")
    release(holders, hot)
    return pairs


def _passages_of(blocks: DataFrame, pairs: DataFrame, k: int = K) -> DataFrame:
    """Passages of pairs of documents, around the words that their seeds cover; a written table. Four bytes of a word's hash stand for it."""
    spark = blocks.sparkSession
    ids = pairs.select(F.explode(F.array("doc_id", "source_id")).alias("id"))
    wanted = spark.sparkContext.broadcast(packed_bits(bit_table(ids, "id")))
    sequences = blocks.select(*_WORDS).mapInArrow(_word_rows(wanted), "doc_id long, words binary")

    def slice_of(words: str, pos: str):
        low = F.greatest(F.lit(0), F.col(f"min_{pos}") - _MARGIN)
        return low, F.substring(words, 4 * low + 1, 4 * (F.col(f"end_{pos}") + _MARGIN - low))

    lo, part = slice_of("all_words", "pos")
    mine = pairs.join(sequences.toDF("doc_id", "all_words"), "doc_id").select("doc_id", "source_id", "min_source_pos", "end_source_pos", lo.alias("lo"), part.alias("words"))
    lo, part = slice_of("all_words", "source_pos")
    both = mine.join(sequences.toDF("source_id", "all_words"), "source_id").select("doc_id", "source_id", "lo", lo.alias("source_lo"), "words", part.alias("source_words"))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "4")
    found = stage(both.mapInArrow(_aligned(k), _PASSAGES), "passage-found")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", _CONF["spark.sql.parquet.columnarReaderBatchSize"])
    return found


def _cut_text(raw: np.ndarray, start: np.ndarray, end: np.ndarray, spans: list[dict]) -> bytes:
    keep = np.ones(len(raw), bool)
    for span in spans:
        if span["s"] < len(start):
            keep[start[span["s"]] : end[min(span["e"], len(end)) - 1]] = False
    return raw[keep].tobytes()


def _without(names: list[str]):
    """Rows of ``names`` with the passages of ``__cut`` taken out of ``text``; rows that lose all words go."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch["__cut"]
            at = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
            columns = {c: batch[c] for c in names}
            if len(at):
                texts, spans = [], cuts.take(pa.array(at)).to_pylist()
                for piece in text_slices(batch["text"].take(pa.array(at))):
                    w = words(piece, lower=False)
                    for d in range(piece.last - piece.first):
                        lo, hi = piece.bounds[d], piece.bounds[d + 1]
                        own = slice(*np.searchsorted(w.doc, [d, d + 1]))
                        texts.append(_cut_text(piece.data[lo:hi], w.start[own] - lo, w.end[own] - lo, spans[piece.first + d]).decode("utf-8", "replace"))
                mask = np.zeros(len(cuts), bool)
                mask[at] = True
                columns["text"] = pc.replace_with_mask(columns["text"], pa.array(mask), pa.array(texts, columns["text"].type))
                if "n_chars" in columns:
                    kind = columns["n_chars"].type
                    columns["n_chars"] = pc.replace_with_mask(columns["n_chars"], pa.array(mask), pa.array([len(t) for t in texts], kind))
                left = np.ones(len(cuts), bool)
                left[at] = [bool(t.strip()) for t in texts]
                columns = {c: v.filter(pa.array(left)) for c, v in columns.items()}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return rows


def remove_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the passages of ``found`` cut out of their texts; rows left without words go, others stay whole."""
    prepare(docs.sparkSession)
    spans = found.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"))).alias("__cut"))
    spans = stage(spans, "passage-cuts")
    joined = docs.join(spans, docs["doc_id"] == spans["__id"], "left").drop("__id")
    return joined.mapInArrow(_without(docs.columns), docs.schema)
