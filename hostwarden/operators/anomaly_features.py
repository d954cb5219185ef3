"""Six behaviour features per event.

Per host: process creations and file changes in the last 5 minutes. Per (host, pid): connections,
distinct addresses and distinct ports of the current activity session, and the mean gap between
connections in the last 5 minutes. A session ends when 5 minutes pass without a connection.

Time is cut into 5-minute slices. Two connections of a pid in one slice are always less than 5
minutes apart, so sessions are a property of whole slices and are found on a table of one row per
(pid, slice). Each slice then needs only its own rows, its predecessor's totals, and the expiry of
its predecessor's connections. Sorts begin with the pid or the slice (see ``scan``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hostwarden.functions import expr as X
from hostwarden.operators import scan
from hostwarden.schema import FEATURES
from hostwarden.session import stage

SEC = 1_000_000
HOST_CHUNK_SEC = 10
_EARLIEST = -(2**63)


def host_rates(events: DataFrame, window_sec: int = 300) -> DataFrame:
    """Add ``proc_per_min, file_mods_per_min``: events of the host in the window ending at each event."""
    us = X.micros("ts")
    minutes = window_sec / 60.0
    proc, files = F.col("source") == "process", F.col("source") == "filesystem"
    start = F.struct(us.alias("t"), F.col("seq").alias("s"), F.lit(1).alias("v"))
    leave = F.when(proc | files, F.struct((us + window_sec * SEC).alias("t"), F.lit(_EARLIEST).cast("bigint").alias("s"), F.lit(-1).alias("v")))
    moves = events.select(
        "host_id", proc.cast("int").alias("p"), files.cast("int").alias("f"), F.struct(*events.columns).alias("_row"),
        F.explode(F.array_compact(F.array(start, leave))).alias("_m"),
    ).select("host_id", "p", "f", F.when(F.col("_m.v") == 1, F.col("_row")).alias("_row"), "_m.*")
    moves = moves.withColumn("_chunk", scan.time_chunk(F.col("t"), HOST_CHUNK_SEC))
    counted = scan.running(
        moves, ["host_id"], ["t", "s"], "_chunk",
        sums={"_procs": F.col("p") * F.col("v"), "_files": F.col("f") * F.col("v")},
    ).where(F.col("_row").isNotNull())
    return counted.select(
        "_row.*", (F.col("_procs") / minutes).alias("proc_per_min"), (F.col("_files") / minutes).alias("file_mods_per_min")
    )


def _slices(net: DataFrame, width: int) -> DataFrame:
    """One row per (pid, slice) with connections: bounds, count and the slice its session began in."""
    key = ["_pid", "host_id"]
    w = Window.partitionBy(*key).orderBy("_slice")
    bounds = net.groupBy(*key, "_slice").agg(
        F.min("_us").alias("first_us"), F.max("_us").alias("last_us"), F.count(F.lit(1)).alias("n")
    )
    is_new = F.coalesce(F.col("first_us") - F.lag("last_us").over(w) >= width, F.lit(True))
    return bounds.withColumn("is_new", is_new).withColumn(
        "session", F.last(F.when(F.col("is_new"), F.col("_slice")), ignorenulls=True).over(w)
    )


def _first_uses(net: DataFrame, slices: DataFrame, column: str, width: int) -> DataFrame:
    """First use of each value within its session, placed in the slice it happened in."""
    key = ["_pid", "host_id"]
    at = F.struct("_us", "seq")
    per_slice = net.where(F.col(column).isNotNull()).groupBy(*key, "_slice", column).agg(F.min(at).alias("at"))
    firsts = per_slice.join(slices.select(*key, "_slice", "session"), [*key, "_slice"]).groupBy(
        *key, "session", column
    ).agg(F.min("at").alias("at"))
    return firsts.select(*key, "session", scan.int_div(F.col("at._us"), width).alias("_slice"), "at")


def process_activity(events: DataFrame, window_sec: int = 300, rows: DataFrame | None = None) -> DataFrame:
    """Add ``conn_per_min, unique_ips, unique_ports_f, avg_interval`` to ``rows`` (default: the events themselves).

    ``rows`` may be the same events with more columns; the session tables are always built from ``events``.
    """
    width = window_sec * SEC
    key = ["_pid", "_slice", "host_id"]
    us = X.micros("ts")
    keyed = {"_us": us, "_pid": F.coalesce("pid", F.lit(0)), "_slice": scan.int_div(us, width)}
    payload = events if rows is None else rows
    base = payload.withColumns(keyed)
    net = events.withColumns(keyed).where(F.col("source") == "network").select(*key, "_us", "seq", "remote_addr", "remote_port")
    # Small next to the events (a row per pid and slice), and read four times.
    slices = stage(_slices(net, width), "slices")
    ips, ports = (_first_uses(net, slices, c, width) for c in ("remote_addr", "remote_port"))

    totals = slices
    for name, firsts in (("ips", ips), ("ports", ports)):
        counts = firsts.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
        totals = totals.join(counts, key, "left").fillna(0, [name])
    through = Window.partitionBy("_pid", "session", "host_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.select(*key, "is_new", "n", "last_us", *[F.sum(c).over(through).alias(f"sum_{c}") for c in ("n", "ips", "ports")])
    carry = totals.select(
        "host_id", "_pid", (F.col("_slice") + 1).alias("_slice"), F.col("n").alias("c_n"), F.col("last_us").alias("c_last"),
        *[F.col(f"sum_{c}").alias(f"c_{c}_sum") for c in ("n", "ips", "ports")],
    )
    starts = totals.select(*key, "is_new")

    zero = F.lit(0)
    is_net = (F.col("source") == "network").cast("int")
    event_rows = base.select(
        *key, F.col("_us").alias("t"), F.col("seq").alias("s"), F.lit(1).alias("sub"), is_net.alias("d_n"),
        zero.alias("d_ip"), zero.alias("d_port"), zero.alias("d_exp"), F.struct(*payload.columns).alias("_row"),
    )
    leaving = net.select(
        "host_id", "_pid", (F.col("_slice") + 1).alias("_slice"), (F.col("_us") + width).alias("t"),
        F.lit(_EARLIEST).cast("bigint").alias("s"), zero.alias("sub"), zero.alias("d_n"), zero.alias("d_ip"), zero.alias("d_port"),
        F.lit(1).alias("d_exp"),
    )

    def markers(firsts: DataFrame, ip: int, port: int) -> DataFrame:
        return firsts.select(
            *key, F.col("at._us").alias("t"), F.col("at.seq").alias("s"), zero.alias("sub"), zero.alias("d_n"),
            F.lit(ip).alias("d_ip"), F.lit(port).alias("d_port"), zero.alias("d_exp"),
        )

    moves = event_rows
    for part in (leaving, markers(ips, 1, 0), markers(ports, 0, 1)):
        moves = moves.unionByName(part, allowMissingColumns=True)
    upto = Window.partitionBy(*key).orderBy("t", "s", "sub").rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy(*key).orderBy(F.desc("t"), F.desc("s"), F.desc("sub")).rowsBetween(Window.unboundedPreceding, 0)
    own_time = F.when(F.col("d_n") == 1, F.col("t"))
    counted = moves.select(
        *key, "t", "_row",
        *[F.sum(c).over(upto).alias(f"r{c}") for c in ("d_n", "d_ip", "d_port", "d_exp")],
        F.min(own_time).over(upto).alias("own_first"), F.max(own_time).over(upto).alias("own_last"),
        F.min(F.when(F.col("d_exp") == 1, F.col("t") - width)).over(onward).alias("prior_first"),
    ).where(F.col("_row").isNotNull())
    joined = counted.join(carry, key, "left").join(starts, key, "left")

    active = F.col("rd_n") > 0
    carried = F.coalesce(F.col("c_last") > F.col("t") - width, F.lit(False))
    continuing = F.coalesce(~F.col("is_new"), F.lit(False))

    def session_total(run: str, total: str):
        """Running count in this slice on top of what the session brought along; before any connection, what is still alive."""
        brought = F.coalesce(F.col(total), F.lit(0))
        return F.when(active, F.col(run) + F.when(continuing, brought).otherwise(0)).otherwise(
            F.when(carried, brought).otherwise(0)
        ).cast("double")

    alive = F.col("rd_n") + F.greatest(F.coalesce(F.col("c_n"), F.lit(0)) - F.col("rd_exp"), F.lit(0))
    newest = F.coalesce("own_last", "c_last")
    oldest = F.coalesce("prior_first", "own_first")
    gap = F.when(alive >= 2, (newest - oldest) / F.lit(1e6) / (alive - 1)).otherwise(0.0)
    return joined.select(
        "_row.*",
        (session_total("rd_n", "c_n_sum") / (window_sec / 60.0)).alias("conn_per_min"),
        session_total("rd_ip", "c_ips_sum").alias("unique_ips"),
        session_total("rd_port", "c_ports_sum").alias("unique_ports_f"),
        gap.alias("avg_interval"),
    )


def features(events: DataFrame, window_sec: int = 300) -> DataFrame:
    """The six features of every event, keyed by (host_id, seq). Only the columns they need travel."""
    narrow = events.select("host_id", "seq", "ts", "source", "pid", "remote_addr", "remote_port")
    both = process_activity(narrow, window_sec, host_rates(narrow.drop("remote_addr", "remote_port"), window_sec))
    return both.select("host_id", "seq", *FEATURES)


def extract(events: DataFrame, window_sec: int = 300) -> DataFrame:
    """Add all six features, in ``schema.FEATURES`` order."""
    return events.join(features(events, window_sec), ["seq", "host_id"]).select(*events.columns, *FEATURES)
