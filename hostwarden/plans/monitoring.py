"""Snapshot tables to one event table that the scoring plan can take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from hostwarden.config import Config
from hostwarden.functions import expr as X
from hostwarden.operators import file_monitor, network_monitor, process_monitor, resource_monitor, scan
from hostwarden.session import stage
from hostwarden.sources.tables import conform_events

_CHUNK_SECONDS = 60


def numbered_events(*parts: DataFrame) -> DataFrame:
    """Event tables as one, with ``seq`` counted anew per host.

    Several events may stem from one snapshot row and each table counts ``seq`` on its own, while the scoring plan
    joins on ``(host_id, seq)``. The new number follows ``(ts, source, kind, seq)``; events that agree in these are
    put in the order of their other columns. Counts are kept per minute and carried on, so no host is one task. A row
    without host or time is numbered like the others.
    """
    events = stage(reduce(DataFrame.unionByName, [conform_events(p) for p in parts]), "monitored")
    plain = [f.name for f in events.schema.fields if f.dataType.typeName() != "map"]
    keyed = events.withColumns({
        "_host": F.coalesce("host_id", F.lit("")), "_us": F.coalesce(X.micros("ts"), F.lit(0)), "_row": F.xxhash64(*plain),
    }).withColumn("_chunk", scan.time_chunk(F.col("_us"), _CHUNK_SECONDS))
    counted = scan.running(keyed, ["_host"], ["_us", "source", "kind", "seq", "_row"], "_chunk", sums={"_n": F.lit(1)})
    return stage(counted.withColumn("seq", F.col("_n").cast("long")).select(*events.columns), "numbered")


def monitored_events(
    processes: DataFrame | None = None,
    connections: DataFrame | None = None,
    files: DataFrame | None = None,
    samples: DataFrame | None = None,
    cfg: Config = Config(),
    learning_end=None,
) -> DataFrame:
    """All events of all monitors over the snapshot tables that are there, ready for ``scoring.score_events``."""
    parts = []
    if processes is not None:
        parts += [process_monitor.new_process_events(processes, cfg, learning_end), process_monitor.spawn_loop_events(processes, cfg, learning_end)]
    if connections is not None:
        parts.append(network_monitor.events(connections, cfg, learning_end))
    if files is not None:
        changed = stage(file_monitor.events(files, learning_end), "file-events")
        parts += [changed, file_monitor.rapid_changes(changed)]
    if samples is not None:
        parts.append(resource_monitor.events(samples, cfg.resource_guard))
    if not parts:
        raise ValueError("no snapshot table given")
    return numbered_events(*parts)
