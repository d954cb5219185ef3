"""Host telemetry derived from the generic ``events`` test table.

The test data has no host telemetry, so each table here is a stateless projection (or a
per-scan aggregate) of ``events``. Time is divided by 720 so that 30 days become one hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostwarden.session import configure, stage

BASE_US = 1704067200000000
TIME_DIVISOR = 720
# One host; written over a column because a bare literal would be folded out of the partition keys.
HOST_EXPR = "concat('h', cast({} % 1 as string)) as host_id"

# fixed values: vocabulary of the derived telemetry
PROCESS_NAMES = (
    "bash", "sshd", "systemd", "curl", "xmrig", "x7f2k9q3m1p5", "sudo", "python3", "gcc", "whoami", "firefox", "chmod",
)
EXE_PREFIXES = ("/usr/bin/", "/tmp/", "/dev/shm/", "/usr/sbin/", "/home/u/.cache/")
REMOTE_PORTS = (4444, 22, 443, 9050, 6667, 3389, 5555, 80)
ADDR_PREFIXES = ("10.0.0.", "192.168.1.", "8.8.8.", "172.20.0.")
FILE_PATHS = ("/etc/shadow", "/etc/passwd", "/etc/sudoers", "/etc/crontab", "/etc/ssh/sshd_config", "/etc/hosts")
WORKER_NAMES = ("stress", "python3", "systemd", "java")


def _pick(values, index: str) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"get(array({items}), cast({index} as int))"


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def keyed(raw: DataFrame, time_divisor: int = TIME_DIVISOR) -> DataFrame:
    """The columns every derived table starts from: event_id, user_id, event_type, k, us."""
    return raw.selectExpr(
        "event_id", "user_id", "event_type",
        "cast(get_json_object(props, '$.k') as int) as k",
        f"{BASE_US} + (unix_micros(cast(ts as timestamp)) - {BASE_US}) div {time_divisor} as us",
    )


def shape_telemetry(raw: DataFrame, time_divisor: int = TIME_DIVISOR) -> DataFrame:
    """``events`` rows (batch or stream) as security events in the engine's event schema."""
    base = keyed(raw, time_divisor).selectExpr(
        "event_id as seq", "timestamp_micros(us) as ts", "k", "event_id",
        "cast(user_id + 1 as int) as pid",
        "case event_type when 'signup' then 'process' when 'view' then 'filesystem' "
        "when 'error' then 'resource' else 'network' end as source",
    ).withColumn("kind", F.expr(
        "case source when 'process' then if(k < 90, 'new_process', 'spawn_loop') "
        "when 'filesystem' then if(k < 90, 'file_modified', 'rapid_changes') "
        "when 'resource' then if(k < 60, 'cpu_abuse', 'memory_abuse') "
        "else case when k < 40 then 'new_outbound' when k < 70 then 'suspicious_port' "
        "when k < 85 then 'high_conn_rate' else 'port_scan' end end"
    ))
    addressed = "kind in ('new_outbound', 'suspicious_port')"
    wide = base.selectExpr(
        "seq", "ts", "source", "kind", "pid", "k", "event_id",
        f"case source when 'process' then {_pick(PROCESS_NAMES, 'k % 12')} "
        f"when 'resource' then {_pick(WORKER_NAMES, 'pid % 4')} end as name",
        f"case when {addressed} then concat({_pick(ADDR_PREFIXES, 'event_id % 4')}, cast(k % 4 as string)) end as remote_addr",
        f"case when {addressed} then {_pick(REMOTE_PORTS, 'k % 8')} end as remote_port",
        f"case when kind = 'file_modified' then {_pick(FILE_PATHS, 'k % 6')} end as path",
    )
    return wide.selectExpr(
        HOST_EXPR.format("event_id"), "seq", "ts", "source", "kind",
        "case kind when 'new_process' then concat('proc:', pid, ':', name) "
        "when 'spawn_loop' then concat('proc:spawn:', pid) "
        "when 'port_scan' then concat('net:scan:', pid) "
        "when 'high_conn_rate' then concat('net:rate:', pid) "
        "when 'file_modified' then concat('file:', path) "
        "when 'rapid_changes' then 'file:rapid' "
        "when 'cpu_abuse' then concat('resource:cpu:', pid) "
        "when 'memory_abuse' then concat('resource:mem:', pid) "
        "else concat('net:', remote_addr, ':', remote_port) end as entity_id",
        "concat(kind, ' pid=', pid) as message",
        "pid", "name",
        f"case source when 'process' then concat({_pick(EXE_PREFIXES, 'event_id % 5')}, name) "
        "when 'resource' then concat('/usr/bin/', name) end as exe",
        "cast(null as string) as cmdline", "cast(null as string) as parent_exe", "cast(null as string) as user",
        "cast(null as string) as created", "remote_addr", "remote_port",
        "cast(null as int) as local_port",
        "cast(case kind when 'high_conn_rate' then 21 + event_id % 60 "
        "when 'rapid_changes' then 5 + event_id % 15 end as int) as count",
        "cast(case when kind = 'port_scan' then 20 + event_id % 60 end as int) as unique_ports",
        "cast(case when kind = 'spawn_loop' then 10 + event_id % 20 end as int) as child_count",
        "cast(null as int) as window_sec", "path",
        "case when kind = 'file_modified' then sha2(concat(path, '#', cast((event_id + 1) % 3 as string)), 256) end as prev_hash",
        "case when kind = 'file_modified' then sha2(concat(path, '#', cast(event_id % 3 as string)), 256) end as new_hash",
        "cast(case when kind = 'file_modified' then 1000 + k end as bigint) as prev_size",
        "cast(case when kind = 'file_modified' then 1000 + 2 * k end as bigint) as new_size",
        "cast(case when kind = 'cpu_abuse' then 80 + k % 20 end as double) as cpu_pct",
        "cast(null as double) as threshold", "cast(null as int) as sustained_sec",
        "cast(case when kind = 'memory_abuse' then 4096 + k end as bigint) as memory_mb",
        "cast(null as map<string,string>) as extra",
    )


def telemetry(spark: SparkSession, sf_dir: str, time_divisor: int = TIME_DIVISOR) -> DataFrame:
    configure(spark)
    return shape_telemetry(raw_events(spark, sf_dir), time_divisor)


def _scan(sec: int) -> str:
    return f"timestamp_micros(us - us % {sec}000000)"


def process_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan per 60 s; the last row per (scan, pid) wins."""
    rows = keyed(raw_events(spark, sf_dir)).where("event_type = 'signup'").selectExpr(
        HOST_EXPR.format("event_id"), f"{_scan(60)} as scan_ts", "event_id as seq", "cast(user_id + 1 as int) as pid",
        f"{_pick(PROCESS_NAMES, 'k % 12')} as name",
        f"concat({_pick(EXE_PREFIXES, 'event_id % 5')}, {_pick(PROCESS_NAMES, 'k % 12')}) as exe",
        "timestamp_micros(us) as created", "cast(1 + event_id % 5 as int) as ppid",
    )
    best = F.max_by(F.struct("seq", "name", "exe", "created", "ppid"), "seq").alias("r")
    return rows.groupBy("host_id", "scan_ts", "pid").agg(best).select(
        "host_id", "scan_ts", "r.seq", "pid", "r.name", "r.exe", "r.created", "r.ppid"
    )


def connection_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan per 60 s, one row per observed connection, three busy processes."""
    return keyed(raw_events(spark, sf_dir)).where("event_type in ('click', 'purchase')").selectExpr(
        HOST_EXPR.format("event_id"), f"{_scan(60)} as scan_ts", "event_id as seq", "cast(user_id % 3 + 1 as int) as pid",
        "case when k % 10 < 7 then 'ESTABLISHED' when k % 10 < 9 then 'SYN_SENT' else 'LISTEN' end as status",
        "cast(40000 + event_id % 2 as int) as local_port",
        f"if(k = 7, '127.0.0.1', concat({_pick(ADDR_PREFIXES, 'event_id % 4')}, cast(k % 2 as string))) as remote_addr",
        f"cast(if(event_id % 3 = 0, {_pick(REMOTE_PORTS, 'k % 8')}, 1000 + event_id % 40) as int) as remote_port",
    )


def file_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan per 60 s; the last row per (scan, path) wins."""
    rows = keyed(raw_events(spark, sf_dir)).where("event_type = 'view'").selectExpr(
        HOST_EXPR.format("event_id"), f"{_scan(60)} as scan_ts", "event_id as seq",
        f"{_pick(FILE_PATHS, 'k % 6')} as path", "k", "us",
    )
    best = F.max_by(F.struct("seq", "k", "us"), "seq").alias("r")
    return rows.groupBy("host_id", "scan_ts", "path").agg(best).selectExpr(
        "host_id", "scan_ts", "path",
        "sha2(concat(path, '#', cast(r.seq % 3 as string)), 256) as hash",
        "timestamp_micros(r.us) as mtime", "cast(1000 + r.k * 10 as bigint) as size",
    )


def resource_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan per 10 s; the last row per (scan, pid) wins; four workers plus a shared name."""
    rows = keyed(raw_events(spark, sf_dir)).where("event_type = 'error'").selectExpr(
        HOST_EXPR.format("event_id"), f"{_scan(10)} as scan_ts", "event_id as seq", "cast(user_id % 5 + 1 as int) as pid",
        "k",
    )
    best = F.max_by(F.struct("seq", "k"), "seq").alias("r")
    return rows.groupBy("host_id", "scan_ts", "pid").agg(best).selectExpr(
        "host_id", "scan_ts", "r.seq as seq", "pid",
        f"{_pick(WORKER_NAMES, 'pid % 4')} as name",
        f"concat('/usr/bin/', {_pick(WORKER_NAMES, 'pid % 4')}) as exe",
        "cast(case pid % 4 when 0 then 97 when 1 then 20 + r.k % 80 when 2 then if(r.k >= 98, 12, 88) else 90 end as double) as cpu_pct",
        "cast((3800 + r.k * 8) as bigint) * 1048576 as rss_bytes",
    )


def addresses(events: DataFrame) -> DataFrame:
    """Every address seen, how often and when first: all that the tables of intelligence below are made from."""
    return events.where("remote_addr is not null").groupBy("remote_addr").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts")
    )


def intel_abuse(events: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Reputation per address seen; entries expire 30 minutes after the address first appears."""
    return (addresses(events) if seen is None else seen).selectExpr(
        "remote_addr as ip", "cast(n % 100 as double) as abuse_score", "'US' as country",
        "cast(n as int) as total_reports", "n % 2 = 0 as is_whitelisted", "concat('isp-', n % 7) as isp",
        "first_ts + interval 30 minutes as expires",
    )


def intel_geo(events: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """One address range per /24 seen (lower half), plus a wider one around it."""
    nets = (events if seen is None else seen).where("remote_addr is not null").selectExpr(
        "substring_index(remote_addr, '.', 3) as net"
    ).groupBy("net").count()
    country = "get(array('RU', 'US', 'CN', 'DE', 'IR'), cast(length(net) % 5 as int))"
    narrow = nets.selectExpr(
        "concat(net, '.0') as ip_from", "concat(net, '.1') as ip_to", f"{country} as country_code",
        f"concat('Country ', {country}) as country", "concat('City ', net) as city",
    )
    wide = nets.selectExpr(
        "concat(net, '.0') as ip_from", "concat(net, '.255') as ip_to", "'SE' as country_code",
        "'Country SE' as country", "concat('Region ', net) as city",
    )
    return narrow.unionByName(wide)


def intel_otx(events: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Raw pulse lists per address, as a feed would deliver them."""
    return (addresses(events) if seen is None else seen).where("n % 4 <> 1").selectExpr(
        "remote_addr as ip",
        "transform(sequence(1, cast(1 + n % 3 as int)), i -> named_struct("
        "'name', concat('pulse-', i), 'tags', array(concat('tag-', i), concat('net-', cast(n % 5 as string))))) as pulse_list",
        "first_ts + interval 30 minutes as expires",
    )


def intel_malware(events: DataFrame) -> DataFrame:
    """Known-bad hashes: every new hash seen in a version that ends in #1."""
    return events.where("kind = 'file_modified'").groupBy("new_hash", "path").agg(F.min("ts").alias("first_ts")).where(
        "new_hash = sha2(concat(path, '#1'), 256)"
    ).selectExpr(
        "new_hash as sha256", "concat('family-', length(path) % 3) as family", "array('elf', 'dropper') as tags",
        "'elf' as file_type", "date_format(first_ts, 'yyyy-MM-dd') as first_seen",
    )


def feedback(events: DataFrame) -> DataFrame:
    """An analyst's verdict on every event, one rule name per kind."""
    return events.selectExpr(
        "entity_id",
        "case kind when 'new_process' then 'suspicious_path' when 'suspicious_port' then 'suspicious_port' "
        "when 'file_modified' then 'critical_file_modified' when 'cpu_abuse' then 'cpu_abuse' else kind end as rule_name",
        "seq % 3 = 0 as false_positive", "ts",
    )


_INGESTED: dict[tuple[str, str, str], DataFrame] = {}


def ingested(spark: SparkSession, sf_dir: str, table: str = "telemetry") -> DataFrame:
    """A derived table, written once per session and folder, then read like any stored table.

    The raw file is a single unsplittable row group at test scale; spreading it before the write
    gives later reads as many splits as there are cores.
    """
    configure(spark)
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _INGESTED:
        maker = {
            "telemetry": telemetry, "process_snapshots": process_snapshots, "connection_snapshots": connection_snapshots,
            "file_snapshots": file_snapshots, "resource_samples": resource_samples,
        }[table]
        df = maker(spark, sf_dir)
        if table == "telemetry" and len(df.inputFiles()) < spark.sparkContext.defaultParallelism:
            df = shape_telemetry(raw_events(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism))
        _INGESTED[key] = stage(df, table)
    return _INGESTED[key]
