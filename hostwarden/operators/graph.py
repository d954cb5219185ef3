"""Correlation graph as node and edge tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from hostwarden.config import CorrelatorConfig
from hostwarden.operators.correlation import has_pid, related_pairs
from hostwarden.session import stage

NODE_KEY = ["host_id", "entity_id"]


def nodes(events: DataFrame, score_col: str = "score") -> DataFrame:
    """Latest event per entity."""
    latest = F.max_by(
        F.struct("source", F.coalesce("pid", F.lit(0)).alias("pid"), F.col(score_col).alias("score"), F.col("ts").alias("last_seen")),
        F.struct("ts", "seq"),
    ).alias("n")
    return events.groupBy(*NODE_KEY).agg(latest).select(*NODE_KEY, "n.*")


def pid_members(events: DataFrame) -> DataFrame:
    """Which entities each process touched: one row per (host, pid, entity)."""
    return events.where(has_pid()).select("host_id", "pid", "entity_id").distinct()


def same_pid_edges(events: DataFrame, cfg: CorrelatorConfig = CorrelatorConfig(), near: DataFrame | None = None) -> DataFrame:
    """An edge from each event's entity to every related entity; only those with an end in ``near(host_id, entity_id)`` if given."""
    return related_pairs(events, cfg, near).select(
        "host_id", "pid", "seq", F.col("entity_id").alias("from_id"), F.col("related_id").alias("to_id"),
        F.lit("same_pid").alias("kind"), F.lit("").alias("pattern"), F.col("ts").alias("created"),
    )


def pattern_edges(events: DataFrame, correlated: DataFrame, cfg: CorrelatorConfig = CorrelatorConfig(), near: DataFrame | None = None) -> DataFrame:
    """One more edge per matched pattern, for events whose patterns are known."""
    matched = correlated.where(F.size("patterns") > 0).select(
        "host_id", "seq", F.explode("patterns").alias("_pattern")
    )
    edges = same_pid_edges(events, cfg, near)
    return edges.join(matched, ["host_id", "seq"]).select(
        "host_id", "pid", "seq", "from_id", "to_id", F.lit("pattern").alias("kind"),
        F.col("_pattern").alias("pattern"), "created",
    )


def prune_nodes(node_table: DataFrame, now, retention_sec: int = 600) -> DataFrame:
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"interval {retention_sec} seconds")
    return node_table.where(F.col("last_seen") >= cutoff)


def prune_edges(edges: DataFrame, live_nodes: DataFrame) -> DataFrame:
    """Keep edges whose both ends are live."""
    ids = live_nodes.select("host_id", "entity_id")
    out = edges
    for end in ("from_id", "to_id"):
        out = out.join(ids.withColumnRenamed("entity_id", end), ["host_id", end], "left_semi")
    return out.select(*edges.columns)


def live_edges(events: DataFrame, now, score_col: str = "score", cfg: CorrelatorConfig = CorrelatorConfig()) -> DataFrame:
    """As ``prune_edges`` of all edges: whether an entity is live does not depend on edges, so only events of live entities are paired."""
    live = prune_nodes(nodes(events, score_col), now, cfg.retention_sec)
    return same_pid_edges(events.join(live, NODE_KEY, "left_semi").select(*events.columns), cfg)


def related_to(events: DataFrame, node_table: DataFrame, starts: DataFrame, hops: int = 3, cfg: CorrelatorConfig = CorrelatorConfig()) -> DataFrame:
    """Entities within ``hops`` undirected same-pid steps of each start (``host_id, entity_id``), with their distance.

    Edges are built hop by hop: once for every process that touched an entity just reached, and for no other. Entities without a
    node are walked through but not returned.
    """
    narrow = stage(events.where(has_pid()).select("host_id", "pid", "seq", "ts", "entity_id"), "walk-events")
    members = stage(narrow.select("host_id", "pid", "entity_id").distinct(), "walk-members")
    built: list[DataFrame] = []
    known: list[DataFrame] = []

    def neighbours(frontier: DataFrame) -> DataFrame:
        reached = members.join(frontier.select("host_id", "entity_id").distinct(), NODE_KEY, "left_semi").select("host_id", "pid").distinct()
        for earlier in built:
            reached = reached.join(earlier, ["host_id", "pid"], "left_anti")
        built.append(stage(reached, "walk-pids"))
        known.append(stage(_both_ways(same_pid_edges(narrow.join(built[-1], ["host_id", "pid"], "left_semi"), cfg)), "walk-edges"))
        return reduce(DataFrame.unionByName, known)

    return _walk(neighbours, node_table, starts, hops)


def related_by(edges: DataFrame, node_table: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """The same over an edge table that is there already; edges of any kind are accepted."""
    both = stage(_both_ways(edges), "neighbours")
    return _walk(lambda frontier: both, node_table, starts, hops)


def _both_ways(edges: DataFrame) -> DataFrame:
    pairs = edges.select("host_id", F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    return pairs.unionByName(pairs.select("host_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _walk(neighbours: Callable[[DataFrame], DataFrame], node_table: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    visited = stage(
        starts.select("host_id", F.col("entity_id").alias("start_id"), "entity_id", F.lit(0).alias("hop")), "starts"
    )
    frontier = visited
    for hop in range(1, hops + 1):
        step = frontier.select("host_id", "start_id", F.col("entity_id").alias("a")).join(neighbours(frontier), ["host_id", "a"])
        frontier = stage(
            step.select("host_id", "start_id", F.col("b").alias("entity_id")).distinct()
            .join(visited, ["host_id", "start_id", "entity_id"], "left_anti")
            .withColumn("hop", F.lit(hop)), "frontier",
        )
        visited = visited.unionByName(frontier)
    return visited.where(F.col("hop") > 0).join(node_table.select(*NODE_KEY), NODE_KEY, "left_semi")


def for_pid(
    events: DataFrame, pid: int, score_col: str = "score", correlated: DataFrame | None = None, cfg: CorrelatorConfig = CorrelatorConfig(),
) -> tuple[DataFrame, DataFrame]:
    """Nodes of one pid, and the edges with either end among them; pattern edges too where ``correlated`` is given.

    The pid's entities come first; nodes and edges are built around them alone.
    """
    events = stage(events.select("host_id", "pid", "seq", "ts", "entity_id", "source", score_col), "pid-events")
    ids = stage(pid_members(events).where(F.col("pid") == pid).select("host_id", "entity_id"), "pid-entities")
    own = nodes(events.join(ids, NODE_KEY, "left_semi").select(*events.columns), score_col)
    edges = same_pid_edges(events, cfg, ids)
    if correlated is not None:
        edges = edges.unionByName(pattern_edges(events, correlated, cfg, ids))
    return own, edges
