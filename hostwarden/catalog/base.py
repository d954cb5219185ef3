"""Registry and the SQL form of the derived telemetry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostwarden.functions import expr as X
from hostwarden.sources import sample_tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise KeyError(name)
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def wrap(fn):
        add(name, fn, sql)
        return fn

    return wrap


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ingested(spark, sf_dir)


def us(col: str = "ts"):
    return X.micros(col).alias("us")


def r6(col, name: str):
    return X.round6(F.col(col) if isinstance(col, str) else col).alias(name)


def _case(source: str, values, index: str) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{items}])[{index} + 1]"


EV = f"""
k0 AS (SELECT event_id, user_id, event_type, CAST(props->>'$.k' AS INTEGER) AS k, epoch_us(ts) AS raw_us,
         {T.BASE_US} + (epoch_us(ts) - {T.BASE_US}) // {T.TIME_DIVISOR} AS us FROM events),
k1 AS (SELECT *, event_id AS seq, CAST(user_id + 1 AS INTEGER) AS pid,
         CASE event_type WHEN 'signup' THEN 'process' WHEN 'view' THEN 'filesystem' WHEN 'error' THEN 'resource' ELSE 'network' END AS source
       FROM k0),
k2 AS (SELECT *, CASE source WHEN 'process' THEN (CASE WHEN k < 90 THEN 'new_process' ELSE 'spawn_loop' END)
         WHEN 'filesystem' THEN (CASE WHEN k < 90 THEN 'file_modified' ELSE 'rapid_changes' END)
         WHEN 'resource' THEN (CASE WHEN k < 60 THEN 'cpu_abuse' ELSE 'memory_abuse' END)
         ELSE (CASE WHEN k < 40 THEN 'new_outbound' WHEN k < 70 THEN 'suspicious_port' WHEN k < 85 THEN 'high_conn_rate' ELSE 'port_scan' END) END AS kind
       FROM k1),
k3 AS (SELECT *,
         CASE source WHEN 'process' THEN {_case('', T.PROCESS_NAMES, 'k % 12')} WHEN 'resource' THEN {_case('', T.WORKER_NAMES, 'pid % 4')} END AS name,
         CASE WHEN kind IN ('new_outbound', 'suspicious_port') THEN {_case('', T.ADDR_PREFIXES, 'event_id % 4')} || CAST(k % 4 AS VARCHAR) END AS remote_addr,
         CASE WHEN kind IN ('new_outbound', 'suspicious_port') THEN {_case('', T.REMOTE_PORTS, 'k % 8')} END AS remote_port,
         CASE WHEN kind = 'file_modified' THEN {_case('', T.FILE_PATHS, 'k % 6')} END AS path
       FROM k2),
ev AS (SELECT 'h0' AS host_id, seq, us, raw_us, source, kind, pid, name, remote_addr, remote_port, path, k,
         CASE kind WHEN 'new_process' THEN 'proc:' || pid || ':' || name WHEN 'spawn_loop' THEN 'proc:spawn:' || pid
           WHEN 'port_scan' THEN 'net:scan:' || pid WHEN 'high_conn_rate' THEN 'net:rate:' || pid
           WHEN 'file_modified' THEN 'file:' || path WHEN 'rapid_changes' THEN 'file:rapid'
           WHEN 'cpu_abuse' THEN 'resource:cpu:' || pid WHEN 'memory_abuse' THEN 'resource:mem:' || pid
           ELSE 'net:' || remote_addr || ':' || remote_port END AS entity_id,
         kind || ' pid=' || pid AS message,
         CASE source WHEN 'process' THEN {_case('', T.EXE_PREFIXES, 'event_id % 5')} || name WHEN 'resource' THEN '/usr/bin/' || name END AS exe,
         CASE kind WHEN 'high_conn_rate' THEN 21 + event_id % 60 WHEN 'rapid_changes' THEN 5 + event_id % 15 END AS cnt,
         CASE WHEN kind = 'port_scan' THEN 20 + event_id % 60 END AS unique_ports,
         CASE WHEN kind = 'spawn_loop' THEN 10 + event_id % 20 END AS child_count,
         CASE WHEN kind = 'file_modified' THEN sha256(path || '#' || CAST((event_id + 1) % 3 AS VARCHAR)) END AS prev_hash,
         CASE WHEN kind = 'file_modified' THEN sha256(path || '#' || CAST(event_id % 3 AS VARCHAR)) END AS new_hash,
         CASE WHEN kind = 'file_modified' THEN 1000 + k END AS prev_size,
         CASE WHEN kind = 'file_modified' THEN 1000 + 2 * k END AS new_size,
         CAST(CASE WHEN kind = 'cpu_abuse' THEN 80 + k % 20 END AS DOUBLE) AS cpu_pct,
         CASE WHEN kind = 'memory_abuse' THEN 4096 + k END AS memory_mb
       FROM k3)"""

ENTROPY = (
    "(SELECT coalesce(-sum(c / n * log2(c / n)), 0.0) FROM (SELECT ch, count(*)::DOUBLE AS c, sum(count(*)) OVER ()::DOUBLE AS n "
    "FROM (SELECT unnest(string_split({col}, '')) AS ch) GROUP BY ch))"
)
NAMES = f"""
names AS (SELECT name, strlen(name) AS bytes, {ENTROPY.format(col='d.name')} AS entropy FROM (SELECT DISTINCT name FROM ev WHERE name IS NOT NULL) d)"""

_TEMP = "(exe LIKE '%/tmp/%' OR exe LIKE '%/var/tmp/%' OR exe LIKE '%/dev/shm/%')"
SUSPICIOUS = "(exe LIKE '%/tmp/%' OR exe LIKE '%/var/tmp/%' OR exe LIKE '%/dev/shm/%' OR exe LIKE '%/.cache/%' OR exe LIKE '%/Downloads/%')"
RULE_SQL = {
    "suspicious_path": f"CASE WHEN source = 'process' AND {SUSPICIOUS} THEN 30 ELSE 0 END",
    "name_mimicry": "CASE WHEN source = 'process' AND exe <> '' AND ((name = 'sshd' AND exe NOT LIKE '/usr/sbin/%') "
    "OR (name = 'systemd' AND exe NOT LIKE '/usr/lib/systemd/%') OR (name = 'cron' AND exe NOT LIKE '/usr/sbin/%') "
    "OR (name = 'init' AND exe NOT LIKE '/sbin/%')) THEN 50 ELSE 0 END",
    "unusual_hour": "CASE WHEN source = 'process' AND (us // 3600000000) % 24 BETWEEN 2 AND 5 THEN 10 ELSE 0 END",
    "privilege_escalation": "CASE WHEN source = 'process' AND (name IN ('su','sudo','pkexec','runuser','newgrp') OR exe LIKE '%/su' OR exe LIKE '%/sudo' "
    "OR exe LIKE '%/pkexec' OR exe LIKE '%/runuser' OR exe LIKE '%/newgrp') THEN 20 ELSE 0 END",
    "scripting_from_temp": f"CASE WHEN source = 'process' AND name IN ('bash','sh','python','python3','perl','ruby','node') AND {_TEMP} THEN 35 ELSE 0 END",
    "high_entropy_name": "CASE WHEN source = 'process' AND bytes > 8 AND entropy > 3.5 THEN 20 ELSE 0 END",
    "suspicious_port": "CASE WHEN kind = 'suspicious_port' THEN 25 ELSE 0 END",
    "high_connection_rate": "CASE WHEN kind = 'high_conn_rate' AND cnt > 50 THEN 40 WHEN kind = 'high_conn_rate' AND cnt > 20 THEN 20 ELSE 0 END",
    "outbound_unusual": "CASE WHEN kind = 'new_outbound' THEN 5 ELSE 0 END",
    "port_scan": "CASE WHEN kind = 'port_scan' AND unique_ports > 50 THEN 70 WHEN kind = 'port_scan' AND unique_ports > 20 THEN 45 ELSE 0 END",
    "critical_file_modified": "CASE WHEN kind = 'file_modified' AND path IN ('/etc/shadow','/etc/passwd','/etc/sudoers') THEN 60 WHEN kind = 'file_modified' THEN 30 ELSE 0 END",
    "rapid_modifications": "CASE WHEN kind = 'rapid_changes' AND cnt > 10 THEN 70 ELSE 0 END",
    "cpu_abuse": "CASE WHEN kind = 'cpu_abuse' AND cpu_pct >= 95 THEN 50 WHEN kind = 'cpu_abuse' THEN 40 ELSE 0 END",
    "memory_abuse": "CASE WHEN kind = 'memory_abuse' THEN 30 ELSE 0 END",
    "spawn_loop": "CASE WHEN kind = 'spawn_loop' AND child_count > 20 THEN 60 WHEN kind = 'spawn_loop' THEN 50 ELSE 0 END",
}
SCORED = f"""{EV}, {NAMES},
hs AS (SELECT ev.*, n.bytes, n.entropy, CAST({' + '.join(f'({s})' for s in RULE_SQL.values())} AS DOUBLE) AS heuristic_score
       FROM ev LEFT JOIN names n USING (name)),
ge AS (SELECT * FROM hs WHERE heuristic_score > 0)"""


def with_ev(select: str, *ctes: str) -> str:
    return f"WITH {', '.join([EV, *ctes])} {select}"


def with_scored(select: str, *ctes: str) -> str:
    return f"WITH {', '.join([SCORED, *ctes])} {select}"


def with_scored_recursive(select: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {', '.join([SCORED, *ctes])} {select}"


SEVERITY_SQL = "CASE WHEN {s} >= 70 THEN 4 WHEN {s} >= 50 THEN 3 WHEN {s} >= 30 THEN 2 WHEN {s} >= 15 THEN 1 ELSE 0 END"
SEVERITY_LABEL_SQL = "CASE WHEN {s} >= 70 THEN 'CRITICAL' WHEN {s} >= 50 THEN 'HIGH' WHEN {s} >= 30 THEN 'MEDIUM' WHEN {s} >= 15 THEN 'LOW' ELSE 'INFO' END"
STATE_SQL = "CASE WHEN {s} >= 90 THEN 4 WHEN {s} >= 65 THEN 3 WHEN {s} >= 35 THEN 2 WHEN {s} >= 15 THEN 1 ELSE 0 END"
