"""Isolation forest: mergeable samples, trees of at most ``sample_size`` rows each, vectorised scoring.

All chance comes from MD5 over text, which any engine can repeat: a row's digest gives two numbers ``a`` and ``b``, and tree
``t`` draws ``(a + t b) mod 2^60`` for the row; a node's digest gives its attribute and the place of its split.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from hostwarden.config import AnomalyConfig
from hostwarden.schema import FEATURES, MODEL_NODE_DDL

_LEAF = -1
_DRAW_BITS = 60


def _digest_number(digest: Column, first: int) -> Column:
    """15 hexadecimal digits, from the given one on, as a number of 60 bits."""
    return F.conv(F.substring(digest, first, 15), 16, 10).cast("bigint")


def _least_of_each_tree(table: pa.Table, size: int, row_id: tuple[str, ...]) -> pa.Table:
    """The ``size`` rows of least draw of every tree, by row id on ties."""
    table = table.sort_by([(c, "ascending") for c in ("tree_id", "draw", *row_id)])
    tree = table["tree_id"].to_numpy()
    return table.filter(pa.array(np.arange(len(tree)) - np.searchsorted(tree, tree, "left") < size))


def _bottom(size: int, row_id: tuple[str, ...], most: int):
    """Merges samples: the least draws of samples are the least draws of all their rows."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            if len(held) > 2 * most:
                held = _least_of_each_tree(held, size, row_id)
        if held is not None:
            yield from _least_of_each_tree(held, size, row_id).combine_chunks().to_batches(10_000)

    return merged


def _draws(trees: int, size: int, row_id: tuple[str, ...]):
    """A task's own sample: draws of a batch for all trees, below the largest draw that each tree's sample holds so far."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(trees, dtype=np.uint64)
        limit = np.full(trees, 1 << _DRAW_BITS, np.int64)
        part = TaskContext.get().partitionId() % 64
        held: list[pa.RecordBatch] = []

        def reduced() -> None:
            table = _least_of_each_tree(pa.Table.from_batches(held), size, row_id).combine_chunks()
            tree, draw = table["tree_id"].to_numpy(), table["draw"].to_numpy()
            full = np.flatnonzero(np.bincount(tree, minlength=trees) >= size)
            limit[full] = draw[np.searchsorted(tree, full, "right") - 1]
            held[:] = table.to_batches()

        for batch in batches:
            for lo in range(0, len(batch), 1024):
                rows = batch.slice(lo, 1024)
                a, b = (rows[c].to_numpy(zero_copy_only=False).astype(np.uint64) for c in ("_a", "_b"))
                draw = b[:, None] * numbers
                draw += a[:, None]
                draw &= np.uint64((1 << _DRAW_BITS) - 1)
                draw = draw.view(np.int64)
                # Only until every tree has a limit: from then on few draws of a block are below it.
                open_ = len(rows) > size and (limit == 1 << _DRAW_BITS).any()
                bound = np.minimum(limit, np.partition(draw, size - 1, axis=0)[size - 1]) if open_ else limit
                at, tree = np.nonzero(draw <= bound)
                if not len(at):
                    continue
                kept = rows.take(pa.array(at))
                columns = {"tree_id": pa.array(tree, pa.int32()), "part": pa.array(np.full(len(at), part), pa.int32()), "draw": pa.array(draw[at, tree])}
                for name in rows.schema.names[2:]:
                    columns[name] = kept[name]
                held.append(pa.RecordBatch.from_pydict(columns))
                if sum(map(len, held)) > 4 * trees * size:
                    reduced()
        if held:
            reduced()
            yield from held

    return drawn


def samples(
    rows: DataFrame, cfg: AnomalyConfig = AnomalyConfig(), features: tuple[str, ...] = FEATURES, row_id: tuple[str, ...] = ("host_id", "seq"),
) -> DataFrame:
    """``tree_id, draw``, row id and features: for each tree the ``sample_size`` rows of least draw, all rows if there are fewer.

    Exact at any size: every task keeps the least draws of its own rows, which are merged in two steps, so no more than
    ``64 * sample_size`` rows of a tree meet in a task. Row ids must be unique.
    """
    size, trees = cfg.sample_size, cfg.num_trees
    digest = F.md5(F.concat_ws(":", F.lit(str(cfg.seed)), *[F.col(c).cast("string") for c in row_id]).cast("binary"))
    keyed = rows.select(digest.alias("_h"), *row_id, *[F.col(c).cast("double").alias(c) for c in features])
    keyed = keyed.select(_digest_number(F.col("_h"), 1).alias("_a"), _digest_number(F.col("_h"), 17).alias("_b"), *row_id, *features)
    ddl = ", ".join(["tree_id int", "part int", "draw bigint", *[f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields[2:]]])
    partial = keyed.mapInArrow(_draws(trees, size, row_id), ddl)
    merge = _bottom(size, row_id, trees * size)
    return partial.repartition("tree_id", "part").mapInArrow(merge, ddl).repartition("tree_id").mapInArrow(merge, ddl).drop("part")


def subsamples(
    rows: DataFrame, cfg: AnomalyConfig = AnomalyConfig(), features: tuple[str, ...] = FEATURES, row_id: tuple[str, ...] = ("host_id", "seq"),
) -> DataFrame:
    """``tree_id`` and features: for each tree ``sample_size`` rows without replacement."""
    return samples(rows, cfg, features, row_id).select("tree_id", *features)


def node_draw(seed: int, tree_id: int, node_id: int, n_features: int) -> tuple[int, float]:
    """Attribute of a node, and where between the least and the largest value it splits, in [0, 1)."""
    digest = hashlib.md5(f"{seed}:{tree_id}:{node_id}".encode()).hexdigest()
    return int(digest[:8], 16) % n_features, int(digest[8:20], 16) / float(1 << 48)


def build_tree(tree_id: int, data: np.ndarray, max_depth: int, seed: int) -> pd.DataFrame:
    """Random splits until a node has one row, is at full depth, or is constant in the drawn attribute.

    The children of node ``i`` are ``2 i + 1`` (below the split) and ``2 i + 2``.
    """
    nodes: list[tuple] = []
    pending = [(np.arange(len(data)), 0, 0)]
    while pending:
        members, depth, node_id = pending.pop()
        if len(members) > 1 and depth < max_depth:
            attr, share = node_draw(seed, tree_id, node_id, data.shape[1])
            values = data[members, attr]
            low, high = values.min(), values.max()
            if low < high:
                cut = low + share * (high - low)
                left, right = 2 * node_id + 1, 2 * node_id + 2
                nodes.append((tree_id, node_id, attr, float(cut), left, right, len(members), depth))
                goes_left = values < cut
                pending.append((members[~goes_left], depth + 1, right))
                pending.append((members[goes_left], depth + 1, left))
                continue
        nodes.append((tree_id, node_id, _LEAF, 0.0, _LEAF, _LEAF, len(members), depth))
    return pd.DataFrame(nodes, columns=["tree_id", "node_id", "attr", "split", "left", "right", "size", "depth"])


def fit(
    rows: DataFrame, cfg: AnomalyConfig = AnomalyConfig(), features: tuple[str, ...] = FEATURES,
    row_id: tuple[str, ...] = ("host_id", "seq"), min_rows: int | None = None,
) -> DataFrame | None:
    """The model as a node table; None when there are too few rows to train on."""
    needed = max(cfg.min_training_rows if min_rows is None else min_rows, 1)
    if (rows.limit(needed).count() if needed < 1 << 31 else rows.count()) < needed:
        return None
    max_depth = math.ceil(math.log2(cfg.sample_size))
    seed, columns = cfg.seed, list(features)

    def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return build_tree(int(key[0]), group[columns].to_numpy(dtype=float), max_depth, seed)

    return subsamples(rows, cfg, features, row_id).groupBy("tree_id").applyInPandas(grow, MODEL_NODE_DDL)


def path_constant(n: float) -> float:
    """Average unsuccessful-search depth over ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _pack(model: pd.DataFrame) -> dict[str, np.ndarray]:
    """Trees in flat arrays with global child positions; a leaf points at itself and knows its path length.

    Node ids may be numbered in any way; the root of a tree is its least.
    """
    model = model.sort_values(["tree_id", "node_id"]).reset_index(drop=True)
    leaf = model["attr"].to_numpy() == _LEAF
    here = np.arange(len(model))
    stride = int(model[["node_id", "left", "right"]].to_numpy().max()) + 1
    tree = model["tree_id"].to_numpy(np.int64)
    name = tree * stride + model["node_id"].to_numpy(np.int64)

    def position(child: str) -> np.ndarray:
        return np.where(leaf, here, np.searchsorted(name, tree * stride + model[child].to_numpy(np.int64)))

    return {
        "roots": np.flatnonzero(np.append(True, tree[1:] != tree[:-1])),
        "attr": np.where(leaf, 0, model["attr"].to_numpy()),
        "split": model["split"].to_numpy(dtype=float),
        # Both children of a node side by side, the one below the split first.
        "child": np.column_stack([position("left"), position("right")]).ravel(),
        "length": np.where(leaf, model["depth"].to_numpy() + np.array([path_constant(s) for s in model["size"]]), 0.0),
        "depth": np.array([int(model["depth"].max())]),
    }


def path_rows(points: np.ndarray, packed: dict[str, np.ndarray]) -> np.ndarray:
    """Mean path length of every point over the trees."""
    at = np.broadcast_to(packed["roots"], (len(points), len(packed["roots"]))).copy()
    values, row = np.ascontiguousarray(points).ravel(), (np.arange(len(points)) * points.shape[1])[:, None]
    for _ in range(int(packed["depth"][0])):
        go_right = ~(values.take(packed["attr"].take(at) + row) < packed["split"].take(at))
        at *= 2
        at += go_right
        at = packed["child"].take(at)
    return packed["length"].take(at).mean(axis=1)


def path_length(
    rows: DataFrame, model: DataFrame, cfg: AnomalyConfig = AnomalyConfig(), features: tuple[str, ...] = FEATURES, out: str = "path_length",
) -> DataFrame:
    """Add the mean depth at which the trees isolate a row, leaves corrected by their size; null for an empty model.

    The model has at most ``num_trees * 2 * sample_size`` small rows, whatever the data size, so it is broadcast.
    """
    limit = cfg.num_trees * 2 * cfg.sample_size
    nodes = model.limit(limit + 1).toPandas()
    if len(nodes) > limit:
        raise ValueError("model is larger than num_trees * 2 * sample_size nodes")
    if nodes.empty:
        return rows.withColumn(out, F.lit(None).cast("double"))
    shared = rows.sparkSession.sparkContext.broadcast(_pack(nodes))

    @pandas_udf("double")
    def mean_path(point: pd.DataFrame) -> pd.Series:
        values, packed = point.to_numpy(dtype=float), shared.value
        # Blocks whose arrays, a number for each point and tree, stay in the processor's cache.
        blocks = [path_rows(values[i : i + 256], packed) for i in range(0, len(values), 256)]
        return pd.Series(np.concatenate(blocks) if blocks else np.empty(0))

    return rows.withColumn(out, mean_path(F.struct(*features)))


def score(
    rows: DataFrame, model: DataFrame | None, cfg: AnomalyConfig = AnomalyConfig(),
    features: tuple[str, ...] = FEATURES, out: str = "anomaly_score",
) -> DataFrame:
    """Add the anomaly score in [0, 1]; 0 without a model."""
    usual = path_constant(cfg.sample_size)
    if model is None or usual == 0:
        return rows.withColumn(out, F.lit(0.0))
    deep = path_length(rows, model, cfg, features, "_path")
    return deep.withColumn(out, F.coalesce(F.pow(F.lit(2.0), -F.col("_path") / F.lit(usual)), F.lit(0.0))).drop("_path")


def bonus(score_col: Column) -> Column:
    return F.when(score_col > 0.95, 50.0).when(score_col > 0.85, 30.0).when(score_col > 0.7, 15.0).otherwise(0.0)


def retraining_rows(features_table: DataFrame, max_rows: int = 1000) -> DataFrame:
    """The last feature rows seen (a top-k sort, not a full sort)."""
    return features_table.orderBy(F.desc("ts"), F.desc("seq")).limit(max_rows)
