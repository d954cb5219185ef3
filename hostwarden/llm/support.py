"""What several operators need: settings, fixed-size tables summed over all rows, bit tables, connected classes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from hostwarden.llm.textbytes import mix
from hostwarden.session import configure, stage

#: Rows in one Arrow batch: long texts must not add up to a batch that fills a worker.
BATCH_ROWS = 1000
BLOOM_BITS = 1 << 23
_CHUNK = 16384


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def summed_table(rows: DataFrame, accumulate: Callable[[pa.RecordBatch, np.ndarray], None], shape: tuple[int, ...]) -> np.ndarray:
    """Counts over all rows in a table of fixed size, which is all that reaches the driver.

    ``accumulate(batch, table)`` adds a batch to the task's own table. The tasks' tables are cut into chunks,
    summed in two steps on the executors, and only the final chunks are collected: 8 bytes a cell at most.
    """
    size = int(np.prod(shape))
    schema = "chunk int, part int, counts binary"

    def packed(tables: dict[int, np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
        for c, piece in tables.items():
            if piece.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "part": pa.array([part], pa.int32()), "counts": pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            accumulate(batch, total.reshape(shape))
        yield from packed({c: total[c : c + _CHUNK] for c in range(0, size, _CHUNK)}, TaskContext.get().partitionId() % 64)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, blob in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist()):
                piece = np.frombuffer(zlib.decompress(blob), np.int64)
                tables[c] = tables[c] + piece if c in tables else piece
        yield from packed(tables, 0)

    once = rows.mapInArrow(partial, schema).repartition("chunk", "part").mapInArrow(added, schema)
    total = np.zeros(size, np.int64)
    for row in once.repartition("chunk").mapInArrow(added, schema).collect():
        piece = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
        total[row["chunk"] : row["chunk"] + len(piece)] += piece
    return total.reshape(shape)


def positions(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys.astype(np.int64).view(np.uint64))
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _set_bits(table: np.ndarray, at: np.ndarray) -> None:
    """Sets these bits of a table of 64-bit words."""
    at = np.sort(at)
    word = at >> 6
    head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    table[word[head]] |= np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), head)


def bit_table(rows: DataFrame, column: str, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of a long column. Its size is ``bits`` whatever the number of rows; a full one only filters less.

    Tasks hold the bits themselves, not a flag for each, and send the parts of their tables that are not empty.
    """
    schema = "part int, words binary"

    def packed(tables: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for p, words in tables.items():
            if words.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "words": pa.array([zlib.compress(words.tobytes(), 1)], pa.binary())})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = np.zeros(bits // 64, np.uint64), []
        for batch in batches:
            held += positions(batch.column(0).to_numpy(zero_copy_only=False), bits)
            if sum(map(len, held)) >= 1 << 17:
                _set_bits(table, np.concatenate(held))
                held = []
        if sum(map(len, held)):
            _set_bits(table, np.concatenate(held))
        yield from packed({p: table[p * _CHUNK : (p + 1) * _CHUNK] for p in range(-(-len(table) // _CHUNK))})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, blob in zip(batch["part"].to_pylist(), batch["words"].to_pylist()):
                words = np.frombuffer(zlib.decompress(blob), np.uint64)
                tables[p] = tables[p] | words if p in tables else words
        yield from packed(tables)

    parts = rows.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(partial, schema)
    table = np.zeros(bits // 64, np.uint64)
    for row in parts.repartition("part").mapInArrow(merged, schema).collect():
        words = np.frombuffer(zlib.decompress(row["words"]), np.uint64)
        table[row["part"] * _CHUNK : row["part"] * _CHUNK + len(words)] = words
    return np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)


def maybe_in(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the bit table; never false for one that is."""
    a, b = positions(keys, len(flags))
    return flags[a] & flags[b]


def packed_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpacked_bits(blob: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8)).view(bool)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These links with every class as a star: each other node next to the smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _star_rows(most: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in stars(table["a"].to_numpy(), table["b"].to_numpy())], ["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 2 * most:
                yield joined()
        if held:
            yield joined()

    return rows


def connected(links: DataFrame, name: str = "links", most: int = 1 << 18) -> DataFrame:
    """Classes of an undirected graph: ``links(a, b)`` of longs to ``(node, component)``, the smallest node of its class.

    Every round each task first turns its part of the links, about ``most`` of them, into stars. Then each node joins
    its neighbour of lowest rank, by id and at random in turn, and the graph shrinks by a constant factor, so rounds
    grow with the logarithm of the longest chain. Links stay on the executors; each round is a written table. Nulls
    and self-links are ignored.
    """

    def rank(column: str, turn: int):
        return F.struct((F.xxhash64(F.lit(turn), column) if turn % 2 else F.lit(0).cast("long")).alias("r"), F.col(column).alias("id"))

    edges = stage(links.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    labels, turn = None, 0
    while left := edges.count():
        edges = stage(edges.coalesce(1 + left // most).mapInArrow(_star_rows(most), "a long, b long"), f"{name}-stars")
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        best = both.groupBy("node").agg(F.min(rank("other", turn)).alias("m"))
        own = rank("node", turn)
        heads = stage(best.select("node", F.when(own < F.col("m"), F.col("node")).otherwise(F.col("m.id")).alias("head")), f"{name}-heads")
        if labels is None:
            labels = heads.select("node", F.col("head").alias("label"))
        else:
            moved = heads.select(F.col("node").alias("label"), "head")
            labels = stage(labels.join(moved, "label", "left").select("node", F.coalesce("head", "label").alias("label")), f"{name}-labels")
        to_a, to_b = heads.select(F.col("node").alias("a"), F.col("head").alias("ha")), heads.select(F.col("node").alias("b"), F.col("head").alias("hb"))
        half = edges.join(to_a, "a").select("b", "ha")
        edges = stage(half.join(to_b, "b").where("ha <> hb").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).distinct(), name)
        turn += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = stage(labels.groupBy("label").agg(F.min("node").alias("component")), f"{name}-least")
    return stage(labels.join(least, "label").select("node", "component"), f"{name}-classes")
