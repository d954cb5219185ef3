"""File snapshots to ``file_modified`` events, and the modification-rate event."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hostwarden.functions import expr as X
from hostwarden.operators import scan
from hostwarden.operators.process_monitor import after_learning


def modified(files: DataFrame, learning_end=None) -> DataFrame:
    """Rows whose hash differs from the last seen state of the path, with the previous hash and size."""
    rows = files.withColumns({"_us": X.micros("scan_ts")}).withColumn("_chunk", scan.time_chunk(F.col("_us"), 86400))
    lagged = scan.lag_values(
        rows, ["host_id", "path"], ["_us"], "_chunk", {"hash": "prev_hash", "size": "prev_size"}
    ).drop("_us", "_chunk")
    return after_learning(lagged, learning_end).where(F.col("prev_hash") != F.col("hash"))


def events(files: DataFrame, learning_end=None) -> DataFrame:
    return modified(files, learning_end).select(
        "host_id", X.micros("scan_ts").alias("seq"), F.col("scan_ts").alias("ts"), F.lit("filesystem").alias("source"),
        F.lit("file_modified").alias("kind"), F.concat(F.lit("file:"), "path").alias("entity_id"),
        F.format_string("File modified: %s (size %d → %d)", "path", "prev_size", "size").alias("message"),
        "path", "prev_hash", F.col("hash").alias("new_hash"), "prev_size", F.col("size").alias("new_size"),
    )


def rapid_changes(file_events: DataFrame, window_sec: int = 60) -> DataFrame:
    """Modified files per host and tumbling window, as events."""
    width = f"{window_sec} seconds"
    counts = file_events.where(F.col("kind") == "file_modified").groupBy(
        "host_id", F.window("ts", width).alias("w")
    ).agg(F.count(F.lit(1)).cast("int").alias("count"))
    return counts.select(
        "host_id", X.micros(F.col("w.end")).alias("seq"), F.col("w.end").alias("ts"),
        F.lit("filesystem").alias("source"), F.lit("rapid_changes").alias("kind"), F.lit("file:rapid").alias("entity_id"),
        F.format_string("Rapid changes: %d files in %ds", "count", F.lit(window_sec)).alias("message"),
        "count", F.lit(window_sec).alias("window_sec"),
    )
