"""Process snapshots to ``new_process`` and ``spawn_loop`` events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hostwarden.config import Config
from hostwarden.functions import expr as X
from hostwarden.operators import scan

SEC = 1_000_000


def scans(snapshots: DataFrame) -> DataFrame:
    """Distinct scan times per host, numbered. One row per scan, not per process."""
    return snapshots.select("host_id", "scan_ts").distinct().withColumn(
        "scan_no", F.dense_rank().over(Window.partitionBy("host_id").orderBy("scan_ts"))
    )


def numbered(snapshots: DataFrame, scan_table: DataFrame | None = None) -> DataFrame:
    return snapshots.join(scans(snapshots) if scan_table is None else scan_table, ["host_id", "scan_ts"])


def appeared(snapshots: DataFrame, key: list[str], scan_table: DataFrame | None = None) -> DataFrame:
    """Rows whose key was not in the previous scan of the host."""
    now = numbered(snapshots, scan_table)
    before = now.select("host_id", *key, (F.col("scan_no") + 1).alias("scan_no")).distinct()
    return now.join(before, ["host_id", *key, "scan_no"], "left_anti").select(*snapshots.columns, "scan_no")


def disappeared(snapshots: DataFrame, key: list[str], scan_table: DataFrame | None = None) -> DataFrame:
    """Keys of the previous scan that are gone, at the scan that misses them."""
    table = scans(snapshots) if scan_table is None else scan_table
    now = numbered(snapshots, table)
    before = now.select("host_id", *key, (F.col("scan_no") + 1).alias("scan_no")).distinct()
    gone = before.join(now, ["host_id", *key, "scan_no"], "left_anti")
    return gone.join(table, ["host_id", "scan_no"]).select("host_id", "scan_ts", "scan_no", *key)


def known_count(snapshots: DataFrame) -> DataFrame:
    """Processes in each host's latest scan."""
    latest = snapshots.groupBy("host_id").agg(F.max("scan_ts").alias("scan_ts"))
    return snapshots.join(latest, ["host_id", "scan_ts"]).groupBy("host_id").agg(
        F.countDistinct("pid").alias("process_count")
    )


def after_learning(df: DataFrame, learning_end=None, ts: str = "scan_ts") -> DataFrame:
    """State advances during learning, events are only kept afterwards."""
    return df if learning_end is None else df.where(F.col(ts) >= F.lit(learning_end).cast("timestamp"))


def spawn_counts(children: DataFrame, window_sec: int) -> DataFrame:
    """Children a parent spawned in the last ``window_sec`` seconds (both ends included), up to each child.

    Each child counts +1 when it appears and -1 once it has left the window, so a running sum is the
    sliding count; no frame is ever rescanned.
    """
    us = X.micros("scan_ts")
    born = children.where(F.col("ppid") > 0).withColumn("_row", F.struct(*children.columns))
    moves = born.select(
        "host_id", "ppid", "_row",
        F.explode(F.array(
            F.struct(us.alias("t"), F.lit(0).alias("leaving"), F.col("seq").alias("s"), F.lit(1).alias("v")),
            F.struct((us + window_sec * SEC).alias("t"), F.lit(1).alias("leaving"), F.col("seq").alias("s"), F.lit(-1).alias("v")),
        )).alias("_m"),
    ).select("host_id", "ppid", F.when(F.col("_m.v") == 1, F.col("_row")).alias("_row"), "_m.*")
    moves = moves.withColumn("_chunk", scan.time_chunk(F.col("t"), 600))
    counted = scan.running(
        moves, ["host_id", "ppid"], ["t", "leaving", "s"], "_chunk", sums={"spawn_count": F.col("v")}
    )
    return counted.where(F.col("_row").isNotNull()).select("_row.*", F.col("spawn_count").cast("int").alias("spawn_count"))


def parent_of(children: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Add ``parent_name, parent_exe_path``: from the child's own scan, else the scan before, else empty.

    A parent listed after its child in the same scan is not known yet, so the scan before applies.
    """
    table = numbered(snapshots)
    parents = table.select(
        "host_id", "scan_no", F.col("pid").alias("ppid"), F.col("seq").alias("p_seq"),
        F.struct("name", "exe").alias("p"),
    )
    same = parents.select("host_id", "scan_no", "ppid", "p_seq", F.col("p").alias("p_same"))
    prior = parents.select("host_id", (F.col("scan_no") + 1).alias("scan_no"), "ppid", F.col("p").alias("p_prior"))
    keys = ["host_id", "scan_no", "ppid"]
    found = children.join(same, keys, "left").join(prior, keys, "left")
    best = F.coalesce(F.when(F.col("p_seq") <= F.col("seq"), F.col("p_same")), F.col("p_prior"))
    return found.select(
        *children.columns,
        F.coalesce(best["name"], F.lit("")).alias("parent_name"), F.coalesce(best["exe"], F.lit("")).alias("parent_exe_path"),
    )


def spawn_loop_events(snapshots: DataFrame, cfg: Config = Config(), learning_end=None) -> DataFrame:
    """One event per new child once its parent has reached the spawn limit; the entity is the parent."""
    guard = cfg.resource_guard
    new = after_learning(appeared(snapshots, ["pid"]), learning_end)
    hot = spawn_counts(new, guard.spawn_loop_window_sec).where(F.col("spawn_count") >= guard.spawn_loop_limit)
    return parent_of(hot, snapshots).select(
        "host_id", "seq", F.col("scan_ts").alias("ts"), F.lit("process").alias("source"),
        F.lit("spawn_loop").alias("kind"), F.format_string("proc:spawn:%d", "ppid").alias("entity_id"),
        F.format_string(
            "Spawn loop: %s (PID %d) spawned %d children in %ds", "parent_name", "ppid", "spawn_count",
            F.lit(guard.spawn_loop_window_sec),
        ).alias("message"),
        F.col("ppid").alias("pid"), F.col("parent_name").alias("name"), F.col("parent_exe_path").alias("exe"),
        F.col("spawn_count").alias("child_count"), F.lit(guard.spawn_loop_window_sec).alias("window_sec"),
    )


def new_process_events(snapshots: DataFrame, cfg: Config = Config(), learning_end=None) -> DataFrame:
    """Untrusted processes that were not in the previous scan."""
    new = after_learning(appeared(snapshots, ["pid"]), learning_end)
    return new.where(~X.name_matches(F.col("name"), cfg.trusted_processes)).select(
        "host_id", "seq", F.col("scan_ts").alias("ts"), F.lit("process").alias("source"),
        F.lit("new_process").alias("kind"), F.format_string("proc:%d:%s", "pid", "name").alias("entity_id"),
        F.format_string("New process: %s (PID %d) exe=%s", "name", "pid", "exe").alias("message"),
        "pid", "name", "exe", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created"),
    )
