"""CPU and memory samples to ``cpu_abuse`` and ``memory_abuse`` events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hostwarden.config import ResourceGuardConfig
from hostwarden.functions import expr as X
from hostwarden.operators import scan
from hostwarden.operators.process_monitor import numbered

SEC = 1_000_000
CHUNK_SEC = 600


def cpu_baseline(samples: DataFrame) -> DataFrame:
    """Add ``base_mean, base_std``: running mean and sample stddev of CPU per (host, name), current sample included.

    Deviations are taken from each chunk's first value and chunks are merged by moments, so a constant
    series has a stddev of exactly 0.
    """
    key = ["host_id", "name"]
    rows = samples.withColumn("_us", X.micros("scan_ts")).withColumn("_chunk", scan.time_chunk(F.col("_us"), CHUNK_SEC))
    within = Window.partitionBy(*key, "_chunk").orderBy("_us", "seq")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_first", F.first("cpu_pct").over(upto)).withColumn("_dev", F.col("cpu_pct") - F.col("_first"))
    local = rows.withColumns({
        "_n": F.count(F.lit(1)).over(upto), "_s1": F.sum("_dev").over(upto),
        "_s2": F.sum(F.col("_dev") * F.col("_dev")).over(upto),
    })
    chunks = local.groupBy(*key, "_chunk").agg(
        F.min("_first").alias("c"), F.count(F.lit(1)).alias("n"), F.sum("_dev").alias("s1"),
        F.sum(F.col("_dev") * F.col("_dev")).alias("s2"),
    )
    all_before = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    origin = F.first("c").over(Window.partitionBy(*key).orderBy("_chunk"))
    shift = F.col("c") - F.col("o")
    chunks = chunks.withColumn("o", origin).withColumns({
        "m1": F.col("s1") + F.col("n") * shift,
        "m2": F.col("s2") + 2 * shift * F.col("s1") + F.col("n") * shift * shift,
    })
    carry = chunks.select(
        *key, "_chunk", "o",
        *[F.coalesce(F.sum(c).over(all_before), F.lit(0)).alias(f"_p{c}") for c in ("n", "m1", "m2")],
    )
    shift = F.col("_first") - F.col("o")
    merged = local.join(carry, [*key, "_chunk"]).withColumns({
        "_N": F.col("_pn") + F.col("_n"),
        "_M1": F.col("_pm1") + F.col("_s1") + F.col("_n") * shift,
        "_M2": F.col("_pm2") + F.col("_s2") + 2 * shift * F.col("_s1") + F.col("_n") * shift * shift,
    })
    spread = F.greatest(F.col("_M2") - F.col("_M1") * F.col("_M1") / F.col("_N"), F.lit(0.0))
    return merged.select(
        *samples.columns,
        (F.col("o") + F.col("_M1") / F.col("_N")).alias("base_mean"),
        F.when(F.col("_N") < 2, 0.0).otherwise(F.sqrt(spread / F.greatest(F.col("_N") - 1, F.lit(1)))).alias("base_std"),
    )


def with_threshold(samples: DataFrame, cfg: ResourceGuardConfig = ResourceGuardConfig()) -> DataFrame:
    """Add ``threshold``: the configured limit, or the learned mean + 3 stddev if that is higher."""
    return cpu_baseline(samples).withColumn(
        "threshold", F.greatest(F.lit(cfg.cpu_threshold), F.col("base_mean") + 3 * F.col("base_std"))
    )


def with_lifetime(samples: DataFrame) -> DataFrame:
    """Add ``life``: the scan number at which the pid's current unbroken presence began.

    A pid has at most one sample per scan, so a (host, pid) group is bounded by the number of scans.
    """
    w = Window.partitionBy("host_id", "pid").orderBy("scan_no")
    rows = numbered(samples)
    start = F.when(F.coalesce(F.lag("scan_no").over(w) != F.col("scan_no") - 1, F.lit(True)), F.col("scan_no"))
    return rows.withColumn("_start", start).withColumn("life", F.last("_start", ignorenulls=True).over(w)).drop("_start")


def sustained(samples: DataFrame, cfg: ResourceGuardConfig = ResourceGuardConfig()) -> DataFrame:
    """Add ``is_sustained``: at least 2 samples in the last 30 s of this lifetime, all at or above the current threshold."""
    rows = with_lifetime(with_threshold(samples, cfg)).withColumn("_us", X.micros("scan_ts"))
    # One sample per scan: the frame holds window / scan interval rows.
    recent = Window.partitionBy("host_id", "pid", "life").orderBy("_us").rangeBetween(
        -(cfg.sustained_seconds * SEC - 1), 0
    )
    return rows.withColumn(
        "is_sustained",
        (F.count(F.lit(1)).over(recent) >= 2) & (F.min("cpu_pct").over(recent) >= F.col("threshold")),
    ).drop("_us")


def with_cooldown(candidates: DataFrame, cooldown_sec: int = 60) -> DataFrame:
    """Keep a candidate when 60 s have passed since the last kept one of its (host, pid, kind, life)."""
    key = ["host_id", "pid", "kind", "life"]
    marked = candidates.withColumn("us", X.micros("scan_ts"))
    kept = scan.spaced(marked, key, cooldown_sec * SEC, CHUNK_SEC * SEC)
    return marked.join(kept, [*key, "us"], "left_semi").drop("us")


def candidates(samples: DataFrame, cfg: ResourceGuardConfig = ResourceGuardConfig()) -> DataFrame:
    """Samples over a limit, before the cooldown, one row per kind."""
    rows = sustained(samples, cfg).withColumn("memory_mb", scan.int_div(F.col("rss_bytes"), 1024 * 1024))
    kinds = F.array_compact(F.array(
        F.when(F.col("is_sustained"), F.lit("cpu_abuse")),
        F.when(F.col("memory_mb") >= cfg.memory_threshold_mb, F.lit("memory_abuse")),
    ))
    return rows.select("*", F.explode(kinds).alias("kind"))


def events(samples: DataFrame, cfg: ResourceGuardConfig = ResourceGuardConfig()) -> DataFrame:
    kept = with_cooldown(candidates(samples, cfg), cfg.cooldown_sec)
    cpu = F.col("kind") == "cpu_abuse"
    return kept.select(
        "host_id", "seq", F.col("scan_ts").alias("ts"), F.lit("resource").alias("source"), "kind",
        F.when(cpu, F.format_string("resource:cpu:%d", "pid")).otherwise(F.format_string("resource:mem:%d", "pid")).alias("entity_id"),
        F.when(cpu, F.format_string(
            "CPU abuse: %s (PID %d) %.1f%% > threshold %.1f%% for >%ds", "name", "pid", "cpu_pct", "threshold",
            F.lit(cfg.sustained_seconds),
        )).otherwise(F.format_string(
            "Memory abuse: %s (PID %d) %dMB (limit %dMB)", "name", "pid", "memory_mb", F.lit(cfg.memory_threshold_mb)
        )).alias("message"),
        "pid", "name", "exe",
        F.when(cpu, F.col("cpu_pct")).alias("cpu_pct"), F.when(cpu, F.col("threshold")).alias("threshold"),
        F.when(cpu, F.lit(cfg.sustained_seconds)).alias("sustained_sec"),
        F.when(~cpu, F.col("memory_mb")).alias("memory_mb"),
    )
