"""Report tables over scored events, entities, graph and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hostwarden.config import Config
from hostwarden.functions import expr as X
from hostwarden.operators import feedback as fb, graph
from hostwarden.operators.process_monitor import known_count

HISTORY = 500


def recent_events(scored: DataFrame, limit: int = HISTORY) -> DataFrame:
    """Newest events first (a top-k sort)."""
    return scored.orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


def threat_level_of(max_state: Column) -> Column:
    return (
        F.when(max_state >= 3, "critical").when(max_state >= 2, "high").when(max_state >= 1, "elevated").otherwise("safe")
    )


def threat_level(entities: DataFrame) -> DataFrame:
    return entities.agg(F.max("state").alias("max_state")).select(threat_level_of(F.col("max_state")).alias("threat_level"))


def active_threats(entities: DataFrame) -> DataFrame:
    return entities.agg(F.count(F.when(F.col("state") >= 2, 1)).alias("active_threats"))


def status(
    scored: DataFrame, entities: DataFrame, snapshots: DataFrame, rule_count: int, cfg: Config = Config(),
    learning: bool = False, anomaly_ready: bool = False, started=None, now=None,
) -> DataFrame:
    """One status row from scalar aggregates."""
    ent = entities.agg(
        F.max("state").alias("_max"), F.count(F.when(F.col("state") >= 2, 1)).alias("active_threats")
    )
    total = scored.agg(F.count(F.lit(1)).alias("total_events"))
    processes = known_count(snapshots).agg(F.coalesce(F.sum("process_count"), F.lit(0)).alias("process_count"))
    up = F.lit(0) if started is None else F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.lit(started).cast("timestamp"))
    return total.crossJoin(ent).crossJoin(processes).select(
        up.cast("bigint").alias("uptime_seconds"), "process_count", F.lit(len(cfg.watched_paths)).alias("files_watched"),
        "total_events", "active_threats", threat_level_of(F.col("_max")).alias("threat_level"),
        F.lit(learning).alias("learning"), F.lit(anomaly_ready).alias("anomaly_ready"), F.lit(rule_count).alias("sigma_rules"),
    )


def correlation_report(events: DataFrame, correlated: DataFrame, pid: int, score_col: str = "score") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around one process."""
    return graph.for_pid(events, pid, score_col, correlated)


def feedback_stats(feedback: DataFrame) -> DataFrame:
    return fb.stats(feedback)


def display(scored: DataFrame, now: Column) -> DataFrame:
    """Columns as a dashboard shows them."""
    return scored.select(
        "host_id", "seq",
        X.score_percent(F.col("score")).alias("score_pct"),
        X.anomaly_percent(F.col("anomaly_score")).alias("anomaly_pct"),
        X.relative_time(F.col("ts"), now).alias("relative_time"),
        X.short_id(F.col("entity_id")).alias("short_id"),
        F.date_format("ts", "HH:mm:ss").alias("clock"),
        F.lower("severity_label").alias("severity_class"),
        X.join_list(F.col("patterns")).alias("pattern_text"),
        X.join_list(F.col("sigma_rules")).alias("sigma_text"),
        (F.size("patterns") > 0).alias("has_patterns"),
        (F.size("sigma_rules") > 0).alias("has_sigma"),
    )
