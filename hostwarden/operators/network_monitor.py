"""Connection snapshots to ``port_scan``, ``suspicious_port``, ``high_conn_rate`` and ``new_outbound`` events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hostwarden.config import Config
from hostwarden.operators import scan
from hostwarden.operators.process_monitor import after_learning, appeared, disappeared, numbered, scans

KEY = ["pid", "local_port", "remote_addr", "remote_port"]
PORTS_FOR_SCAN = 20
CONNECTIONS_FOR_RATE = 20
PERIOD_SEC = 60
CHUNK_SEC = 3600


def active(connections: DataFrame) -> DataFrame:
    """Established or opening connections to a remote, non-loopback address."""
    return connections.where(
        F.col("status").isin("ESTABLISHED", "SYN_SENT")
        & ~F.coalesce(F.col("remote_addr"), F.lit("")).isin("127.0.0.1", "::1", "")
    )


def closed(connections: DataFrame) -> DataFrame:
    """Connections gone since the previous scan."""
    return disappeared(active(connections), KEY, scans(connections))


def periods(connections: DataFrame) -> DataFrame:
    """Scan times with their counter period: a scan more than 60 s after the last reset starts a new one.

    Works on one small row per scan, not per connection, by hours.
    """
    table = scans(connections).select("host_id", F.unix_micros("scan_ts").alias("us"), "scan_no")
    resets = scan.spaced(table, ["host_id"], PERIOD_SEC * 1_000_000 + 1, CHUNK_SEC * 1_000_000).withColumn("reset", F.lit(1))
    rows = table.join(resets, ["host_id", "us"], "left").withColumn("chunk", scan.time_chunk(F.col("us"), CHUNK_SEC))
    counted = scan.running(rows, ["host_id"], ["us"], "chunk", sums={"resets": F.col("reset")})
    return counted.select("host_id", F.timestamp_micros("us").alias("scan_ts"), "scan_no", (F.col("resets") - 1).cast("bigint").alias("period_id"))


def counted(connections: DataFrame) -> DataFrame:
    """Active connections with ``conn_count`` and ``port_count`` so far in the (pid, period), and ``is_new``."""
    table = periods(connections)
    rows = active(connections).join(table, ["host_id", "scan_ts"])
    group = ["host_id", "pid", "period_id"]
    first_port = F.row_number().over(
        Window.partitionBy(*group, "remote_port").orderBy("scan_ts", "seq")
    ) == 1
    rows = rows.withColumn("_first_port", first_port.cast("int"))
    upto = Window.partitionBy(*group).orderBy("scan_ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "conn_count": F.count(F.lit(1)).over(upto).cast("int"),
        "port_count": F.sum("_first_port").over(upto).cast("int"),
    }).drop("_first_port")
    # New: not in the previous scan, and the first row of its key in this one.
    before = rows.select("host_id", *KEY, (F.col("scan_no") + 1).alias("scan_no")).distinct().withColumn(
        "_known", F.lit(True)
    )
    first_in_scan = F.row_number().over(Window.partitionBy("host_id", *KEY, "scan_no").orderBy("seq")) == 1
    flagged = rows.join(before, ["host_id", *KEY, "scan_no"], "left").withColumn("_first", first_in_scan)
    return flagged.withColumn("is_new", F.col("_known").isNull() & F.col("_first")).drop("_known", "_first")


def new_connections(connections: DataFrame) -> DataFrame:
    return appeared(active(connections), KEY, scans(connections))


def classified(connections: DataFrame, cfg: Config = Config(), learning_end=None) -> DataFrame:
    """New connections with ``emit_scan`` and ``verdict`` (suspicious_port, high_conn_rate or new_outbound; null = none)."""
    new = after_learning(counted(connections).where("is_new"), learning_end)
    group = Window.partitionBy("host_id", "pid", "period_id").orderBy("scan_ts", "seq").rowsBetween(
        Window.unboundedPreceding, 0
    )
    scanning = F.col("port_count") >= PORTS_FOR_SCAN
    suspicious = F.col("remote_port").isin(*cfg.suspicious_ports)
    busy = ~suspicious & (F.col("conn_count") > CONNECTIONS_FOR_RATE)
    return new.withColumns({
        "emit_scan": scanning & (F.sum(scanning.cast("int")).over(group) == 1),
        "_first_busy": busy & (F.sum(busy.cast("int")).over(group) == 1),
    }).withColumn(
        "verdict",
        F.when(suspicious, "suspicious_port")
        .when(F.col("_first_busy"), "high_conn_rate")
        .when(~busy, "new_outbound"),
    ).drop("_first_busy")


def events(connections: DataFrame, cfg: Config = Config(), learning_end=None) -> DataFrame:
    """All network events; a port scan does not stop the connection's own verdict."""
    rows = classified(connections, cfg, learning_end)
    kinds = F.array_compact(F.array(F.when(F.col("emit_scan"), F.lit("port_scan")), F.col("verdict")))
    each = rows.select("*", F.explode(kinds).alias("kind"))
    kind = F.col("kind")
    addressed = kind.isin("suspicious_port", "new_outbound")
    target = F.format_string("%s:%d", "remote_addr", "remote_port")
    return each.select(
        "host_id", "seq", F.col("scan_ts").alias("ts"), F.lit("network").alias("source"), "kind",
        F.when(kind == "port_scan", F.format_string("net:scan:%d", "pid"))
        .when(kind == "high_conn_rate", F.format_string("net:rate:%d", "pid"))
        .otherwise(F.concat(F.lit("net:"), target)).alias("entity_id"),
        F.when(kind == "port_scan", F.format_string("Port scan: PID %d connected to %d distinct ports/min", "pid", "port_count"))
        .when(kind == "high_conn_rate", F.format_string("High connection rate: PID %d has %d connections/min", "pid", "conn_count"))
        .when(kind == "suspicious_port", F.concat(F.format_string("Suspicious port: PID %d → ", "pid"), target))
        .otherwise(F.concat(F.format_string("New outbound: PID %d → ", "pid"), target)).alias("message"),
        "pid",
        F.when(addressed, F.col("remote_addr")).alias("remote_addr"),
        F.when(addressed, F.col("remote_port")).alias("remote_port"),
        F.when(kind == "suspicious_port", F.col("local_port")).alias("local_port"),
        F.when(kind == "high_conn_rate", F.col("conn_count")).alias("count"),
        F.when(kind == "port_scan", F.col("port_count")).alias("unique_ports"),
    )
