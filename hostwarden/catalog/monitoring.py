"""Snapshot sources and the monitors over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostwarden.catalog.base import EV, NAMES, add, ev, query, r6, us, with_ev  # noqa: F401
from hostwarden.catalog.correlating import CONN
from hostwarden.config import EXEMPT_PROCESSES, SUSPICIOUS_PORTS, TRUSTED_PROCESSES, Config, ResourceGuardConfig
from hostwarden.functions import expr as X
from hostwarden.operators import file_monitor as FM, network_monitor as N, process_monitor as P, resource_monitor as R
from hostwarden.sources import sample_tables as T, sinks as K
from hostwarden.sources.tables import content_hash

MIN = 60_000_000
_NAMES = "([" + ", ".join(f"'{n}'" for n in T.PROCESS_NAMES) + "])[k % 12 + 1]"
_EXES = "([" + ", ".join(f"'{n}'" for n in T.EXE_PREFIXES) + "])[event_id % 5 + 1]"
_WORKERS = "([" + ", ".join(f"'{n}'" for n in T.WORKER_NAMES) + "])[pid % 4 + 1]"
_PATHS = "([" + ", ".join(f"'{n}'" for n in T.FILE_PATHS) + "])[k % 6 + 1]"
PS = f"""
ps AS (SELECT scan_us, pid, seq, name, exe, created_us, ppid FROM (
         SELECT us - us % {MIN} AS scan_us, CAST(user_id + 1 AS INTEGER) AS pid, event_id AS seq, {_NAMES} AS name, {_EXES} || {_NAMES} AS exe, us AS created_us,
           CAST(1 + event_id % 5 AS INTEGER) AS ppid, row_number() OVER (PARTITION BY us - us % {MIN}, user_id ORDER BY event_id DESC) AS rn
         FROM k0 WHERE event_type = 'signup') WHERE rn = 1),
psn AS (SELECT *, dense_rank() OVER (ORDER BY scan_us) AS n FROM ps),
pnew AS (SELECT p.* FROM psn p WHERE NOT EXISTS (SELECT 1 FROM psn q WHERE q.pid = p.pid AND q.n = p.n - 1))"""
FS = f"""
fs AS (SELECT scan_us, path, seq, sha256(path || '#' || CAST(seq % 3 AS VARCHAR)) AS hash, us AS mtime_us, 1000 + k * 10 AS size FROM (
         SELECT us - us % {MIN} AS scan_us, {_PATHS} AS path, event_id AS seq, us, k, row_number() OVER (PARTITION BY us - us % {MIN}, {_PATHS} ORDER BY event_id DESC) AS rn
         FROM k0 WHERE event_type = 'view') WHERE rn = 1),
fl AS (SELECT *, lag(hash) OVER w AS prev_hash, lag(size) OVER w AS prev_size FROM fs WINDOW w AS (PARTITION BY path ORDER BY scan_us)),
fmod AS (SELECT * FROM fl WHERE prev_hash <> hash)"""
RS = f"""
rs AS (SELECT scan_us, pid, seq, {_WORKERS} AS name, CAST(CASE pid % 4 WHEN 0 THEN 97 WHEN 1 THEN 20 + k % 80 WHEN 2 THEN (CASE WHEN k >= 98 THEN 12 ELSE 88 END) ELSE 90 END AS DOUBLE) AS cpu_pct,
         CAST(3800 + k * 8 AS BIGINT) * 1048576 AS rss_bytes FROM (
         SELECT us - us % 10000000 AS scan_us, CAST(user_id % 5 + 1 AS INTEGER) AS pid, event_id AS seq, k, row_number() OVER (PARTITION BY us - us % 10000000, user_id % 5 ORDER BY event_id DESC) AS rn
         FROM k0 WHERE event_type = 'error') WHERE rn = 1),
rb AS (SELECT *, dense_rank() OVER (ORDER BY scan_us) AS n, avg(cpu_pct) OVER w AS mean, CASE WHEN count(*) OVER w < 2 THEN 0 ELSE coalesce(stddev_samp(cpu_pct) OVER w, 0) END AS std
       FROM rs WINDOW w AS (PARTITION BY name ORDER BY scan_us, seq ROWS UNBOUNDED PRECEDING)),
rt AS (SELECT *, greatest(85.0, mean + 3 * std) AS threshold, n - row_number() OVER (PARTITION BY pid ORDER BY n) AS life FROM rb),
rsus AS (SELECT *, count(*) OVER w >= 2 AND min(cpu_pct) OVER w >= threshold - 1e-9 AS sustained FROM rt
         WINDOW w AS (PARTITION BY pid, life ORDER BY scan_us RANGE BETWEEN 29999999 PRECEDING AND CURRENT ROW)),
rc AS (SELECT *, row_number() OVER (PARTITION BY pid, life, kind ORDER BY scan_us) AS rn FROM (
         SELECT *, 'cpu_abuse' AS kind FROM rsus WHERE sustained UNION ALL SELECT *, 'memory_abuse' AS kind FROM rsus WHERE rss_bytes // 1048576 >= 4096)),
cool AS (SELECT pid, life, kind, rn, scan_us, scan_us AS last_us, true AS emit FROM rc WHERE rn = 1
         UNION ALL SELECT r.pid, r.life, r.kind, r.rn, r.scan_us, CASE WHEN r.scan_us - c.last_us >= 60000000 THEN r.scan_us ELSE c.last_us END, r.scan_us - c.last_us >= 60000000
         FROM cool c JOIN rc r ON r.pid = c.pid AND r.life = c.life AND r.kind = c.kind AND r.rn = c.rn + 1),
rev AS (SELECT rc.* FROM rc JOIN cool USING (pid, life, kind, rn) WHERE emit)"""


def ps(spark, sf):
    return T.ingested(spark, sf, "process_snapshots")


def cs(spark, sf):
    return T.ingested(spark, sf, "connection_snapshots")


def fs(spark, sf):
    return T.ingested(spark, sf, "file_snapshots")


def rs(spark, sf):
    return T.ingested(spark, sf, "resource_samples")


def sql(select: str, *ctes: str) -> str:
    return with_ev(select, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


# --- sources ---------------------------------------------------------------------
add(
    "s1_process_snapshots", lambda spark, sf: ps(spark, sf).select(us("scan_ts"), "pid", "seq", "name", "exe", X.micros("created").alias("created_us"), "ppid"),
    sql("SELECT scan_us AS us, pid, seq, name, exe, created_us, ppid FROM ps", PS),
)
add(
    "s2_connection_snapshots", lambda spark, sf: cs(spark, sf).select(us("scan_ts"), "seq", "pid", "status", "local_port", "remote_addr", "remote_port"),
    sql("SELECT scan_us AS us, seq, pid, status, local_port, remote_addr, remote_port FROM cn", CONN),
)
add(
    "s3_file_snapshots", lambda spark, sf: fs(spark, sf).select(us("scan_ts"), "path", "hash", X.micros("mtime").alias("mtime_us"), "size"),
    sql("SELECT scan_us AS us, path, hash, mtime_us, size FROM fs", FS),
)
add(
    "s4_resource_samples", lambda spark, sf: rs(spark, sf).select(us("scan_ts"), "seq", "pid", "name", "cpu_pct", "rss_bytes"),
    sql("SELECT scan_us AS us, seq, pid, name, cpu_pct, rss_bytes FROM rs", RS),
)


@query("s5_events_json", with_ev("SELECT seq, us, source, kind, entity_id, pid, name, exe, remote_addr, remote_port, path, cpu_pct FROM ev"))
def _events_json(spark, sf):
    """Events written as JSON and read back through the event source."""
    import uuid

    from hostwarden.session import shared_dir
    from hostwarden.sources.tables import read_table

    source = ev(spark, sf)
    folder = f"{shared_dir(spark).rstrip('/')}/events-json-{uuid.uuid4().hex}"
    source.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder)
    return read_table(spark, "events", folder, "json").select(
        "seq", us("ts"), "source", "kind", "entity_id", "pid", "name", "exe", "remote_addr", "remote_port", "path", "cpu_pct"
    )


# --- processes --------------------------------------------------------------------
_TRUSTED = " OR ".join(f"name LIKE '{p[:-1]}%'" if p.endswith("*") else f"name = '{p}'" for p in TRUSTED_PROCESSES).replace("_", "\\_").replace("%'", "%' ESCAPE '\\'")
add(
    "m1_new_process", lambda spark, sf: P.new_process_events(ps(spark, sf)).select("seq", us("ts"), "pid", "name", "entity_id", "message", "created"),
    sql(
        f"SELECT seq, scan_us AS us, pid, name, 'proc:' || pid || ':' || name AS entity_id, 'New process: ' || name || ' (PID ' || pid || ') exe=' || exe AS message, "
        f"strftime(make_timestamp(created_us), '%Y-%m-%dT%H:%M:%SZ') AS created FROM pnew WHERE NOT ({_TRUSTED})", PS,
    ),
)
add(
    "m2_trusted_filter", lambda spark, sf: ps(spark, sf).select("seq", X.name_matches(F.col("name"), TRUSTED_PROCESSES).cast("int").alias("trusted")),
    sql(f"SELECT seq, CASE WHEN {_TRUSTED} THEN 1 ELSE 0 END AS trusted FROM ps", PS),
)
add(
    "m3_terminated_processes", lambda spark, sf: P.disappeared(ps(spark, sf), ["pid"]).select(us("scan_ts"), "pid"),
    sql(
        "SELECT s.scan_us AS us, p.pid FROM psn p JOIN (SELECT DISTINCT n, scan_us FROM psn) s ON s.n = p.n + 1 WHERE NOT EXISTS (SELECT 1 FROM psn q WHERE q.pid = p.pid AND q.n = p.n + 1)", PS,
    ),
)
add(
    "m4_known_count", lambda spark, sf: P.known_count(ps(spark, sf)).select("process_count"),
    sql("SELECT count(DISTINCT pid) AS process_count FROM ps WHERE scan_us = (SELECT max(scan_us) FROM ps)", PS),
)
_PARENT = (
    "LEFT JOIN psn s ON s.pid = c.ppid AND s.n = c.n AND s.seq <= c.seq LEFT JOIN psn b ON b.pid = c.ppid AND b.n = c.n - 1"
)
add(
    "m5_parent_lookup",
    lambda spark, sf: P.parent_of(P.appeared(ps(spark, sf), ["pid"]), ps(spark, sf)).select("seq", "ppid", "parent_name", F.col("parent_exe_path").alias("parent_exe")),
    sql(f"SELECT c.seq, c.ppid, coalesce(s.name, b.name, '') AS parent_name, coalesce(s.exe, b.exe, '') AS parent_exe FROM pnew c {_PARENT}", PS),
)
_SPAWN = """
sp AS (SELECT c.*, (SELECT count(*) FROM pnew d WHERE d.ppid = c.ppid AND d.scan_us >= c.scan_us - 60000000 AND (d.scan_us < c.scan_us OR (d.scan_us = c.scan_us AND d.seq <= c.seq))) AS spawn_count
       FROM pnew c WHERE ppid > 0)"""
add(
    "m6_spawn_count", lambda spark, sf: P.spawn_counts(P.appeared(ps(spark, sf), ["pid"]), 60).select("seq", "ppid", "spawn_count"),
    sql("SELECT seq, ppid, spawn_count FROM sp", PS, _SPAWN),
)
add(
    "m7_spawn_loop", lambda spark, sf: P.spawn_loop_events(ps(spark, sf)).select("seq", us("ts"), "pid", "name", "exe", "child_count", "entity_id", "message"),
    sql(
        "SELECT c.seq, c.scan_us AS us, c.ppid AS pid, coalesce(s.name, b.name, '') AS name, coalesce(s.exe, b.exe, '') AS exe, c.spawn_count AS child_count, 'proc:spawn:' || c.ppid AS entity_id, "
        f"'Spawn loop: ' || coalesce(s.name, b.name, '') || ' (PID ' || c.ppid || ') spawned ' || c.spawn_count || ' children in 60s' AS message FROM sp c {_PARENT} WHERE c.spawn_count >= 10", PS, _SPAWN,
    ),
)
_LEARN = 1704067200000000 + 1_200_000_000
add(
    "m24_learning_gate", lambda spark, sf: P.new_process_events(ps(spark, sf), Config(), F.timestamp_micros(F.lit(_LEARN))).select("seq", "pid"),
    sql(f"SELECT seq, pid FROM pnew WHERE NOT ({_TRUSTED}) AND scan_us >= {_LEARN}", PS),
)

add(
    "m24_learning_gate_spawns", lambda spark, sf: P.spawn_loop_events(ps(spark, sf), Config(), F.timestamp_micros(F.lit(_LEARN))).select("seq", "pid", "child_count"),
    # Children seen while learning do not count.
    sql("SELECT seq, ppid AS pid, spawn_count AS child_count FROM sp WHERE spawn_count >= 10", PS, _SPAWN.replace("pnew", f"(SELECT * FROM pnew WHERE scan_us >= {_LEARN})")),
)

# --- connections --------------------------------------------------------------------
_PORTS = ", ".join(map(str, SUSPICIOUS_PORTS))
NET = CONN + f""",
sc AS (SELECT scan_us, row_number() OVER (ORDER BY scan_us) AS n FROM (SELECT DISTINCT scan_us FROM cn)),
per AS (SELECT scan_us, n, scan_us AS reset_us, 0::BIGINT AS period_id FROM sc WHERE n = 1
        UNION ALL SELECT s.scan_us, s.n, CASE WHEN s.scan_us - p.reset_us > 60000000 THEN s.scan_us ELSE p.reset_us END, p.period_id + CASE WHEN s.scan_us - p.reset_us > 60000000 THEN 1 ELSE 0 END
        FROM per p JOIN sc s ON s.n = p.n + 1),
act AS (SELECT cn.*, per.n, per.period_id FROM cn JOIN per USING (scan_us) WHERE status IN ('ESTABLISHED', 'SYN_SENT') AND remote_addr NOT IN ('127.0.0.1', '::1', '')),
cnt AS (SELECT a.*, count(*) OVER (PARTITION BY pid, period_id ORDER BY scan_us, seq ROWS UNBOUNDED PRECEDING) AS conn_count,
          (SELECT count(DISTINCT b.remote_port) FROM act b WHERE b.pid = a.pid AND b.period_id = a.period_id AND (b.scan_us < a.scan_us OR (b.scan_us = a.scan_us AND b.seq <= a.seq))) AS port_count,
          NOT EXISTS (SELECT 1 FROM act b WHERE b.pid = a.pid AND b.local_port = a.local_port AND b.remote_addr = a.remote_addr AND b.remote_port = a.remote_port
                      AND (b.n = a.n - 1 OR (b.n = a.n AND b.seq < a.seq))) AS is_new FROM act a),
nw AS (SELECT *, port_count >= 20 AND count(*) FILTER (port_count >= 20) OVER w = 1 AS emit_scan, remote_port IN ({_PORTS}) AS susp,
         remote_port NOT IN ({_PORTS}) AND conn_count > 20 AS busy,
         count(*) FILTER (remote_port NOT IN ({_PORTS}) AND conn_count > 20) OVER w AS busy_no FROM cnt WHERE is_new
       WINDOW w AS (PARTITION BY pid, period_id ORDER BY scan_us, seq ROWS UNBOUNDED PRECEDING)),
vd AS (SELECT *, CASE WHEN susp THEN 'suspicious_port' WHEN busy AND busy_no = 1 THEN 'high_conn_rate' WHEN NOT busy THEN 'new_outbound' END AS verdict FROM nw),
nev AS (SELECT *, 'port_scan' AS kind, 'net:scan:' || pid AS entity_id, 'Port scan: PID ' || pid || ' connected to ' || port_count || ' distinct ports/min' AS message FROM vd WHERE emit_scan
        UNION ALL SELECT *, verdict, CASE WHEN verdict = 'high_conn_rate' THEN 'net:rate:' || pid ELSE 'net:' || remote_addr || ':' || remote_port END,
          CASE verdict WHEN 'high_conn_rate' THEN 'High connection rate: PID ' || pid || ' has ' || conn_count || ' connections/min'
            WHEN 'suspicious_port' THEN 'Suspicious port: PID ' || pid || ' → ' || remote_addr || ':' || remote_port ELSE 'New outbound: PID ' || pid || ' → ' || remote_addr || ':' || remote_port END
        FROM vd WHERE verdict IS NOT NULL)"""
add(
    "m3_closed_connections", lambda spark, sf: N.closed(cs(spark, sf)).select(us("scan_ts"), *N.KEY),
    sql(
        "SELECT DISTINCT s.scan_us AS us, a.pid, a.local_port, a.remote_addr, a.remote_port FROM act a JOIN sc s ON s.n = a.n + 1 WHERE NOT EXISTS (SELECT 1 FROM act b WHERE b.n = a.n + 1 "
        "AND b.pid = a.pid AND b.local_port = a.local_port AND b.remote_addr = a.remote_addr AND b.remote_port = a.remote_port)", NET,
    ),
)
add("m8_active_connections", lambda spark, sf: N.active(cs(spark, sf)).select("seq", "status", "remote_addr"), sql("SELECT seq, status, remote_addr FROM act", NET))
add("m9_new_connections", lambda spark, sf: N.counted(cs(spark, sf)).where("is_new").select("seq", "pid", "remote_port"), sql("SELECT seq, pid, remote_port FROM cnt WHERE is_new", NET))
add("m10_counter_periods", lambda spark, sf: N.periods(cs(spark, sf)).select(us("scan_ts"), "period_id"), sql("SELECT scan_us AS us, period_id FROM per", NET))
add("m11_connection_count", lambda spark, sf: N.counted(cs(spark, sf)).select("seq", "conn_count"), sql("SELECT seq, conn_count FROM cnt", NET))
add("m12_distinct_ports", lambda spark, sf: N.counted(cs(spark, sf)).select("seq", "port_count"), sql("SELECT seq, port_count FROM cnt", NET))
_NSQL = "seq, scan_us AS us, pid, entity_id, message"
for _id, _kind in (("m13", "port_scan"), ("m14", "suspicious_port"), ("m15", "high_conn_rate"), ("m16", "new_outbound")):
    add(
        f"{_id}_{_kind}", lambda spark, sf, k=_kind: N.events(cs(spark, sf)).where(F.col("kind") == k).select("seq", us("ts"), "pid", "entity_id", "message"),
        sql(f"SELECT {_NSQL} FROM nev WHERE kind = '{_kind}'", NET),
    )

add(
    "m24_learning_gate_network", lambda spark, sf: N.events(cs(spark, sf), Config(), F.timestamp_micros(F.lit(_LEARN))).select("seq", us("ts"), "pid", "kind"),
    sql("SELECT seq, scan_us AS us, pid, kind FROM nev", NET.replace("FROM cnt WHERE is_new", f"FROM cnt WHERE is_new AND scan_us >= {_LEARN}")),
)
add(
    "m24_learning_gate_files", lambda spark, sf: FM.events(fs(spark, sf), F.timestamp_micros(F.lit(_LEARN))).select(us("ts"), "path", "new_hash"),
    sql(f"SELECT scan_us AS us, path, hash AS new_hash FROM fmod WHERE scan_us >= {_LEARN}", FS),
)

# --- files ---------------------------------------------------------------------------
add(
    "m17_content_hash", lambda spark, sf: spark.read.parquet(f"{sf}/pages.parquet").select("page_id", content_hash(F.col("html").cast("binary")).alias("hash")),
    "SELECT page_id, sha256(html) AS hash FROM pages",
)
add(
    "m18_file_modified", lambda spark, sf: FM.events(fs(spark, sf)).select(us("ts"), "path", "prev_hash", "new_hash", "prev_size", "new_size", "message"),
    sql(
        "SELECT scan_us AS us, path, prev_hash, hash AS new_hash, prev_size, size AS new_size, 'File modified: ' || path || ' (size ' || prev_size || ' → ' || size || ')' AS message FROM fmod", FS,
    ),
)
add(
    "m26_rapid_changes", lambda spark, sf: FM.rapid_changes(FM.events(fs(spark, sf)), 300).select(us("ts"), F.col("count").alias("n")),
    sql("SELECT (scan_us // 300000000 + 1) * 300000000 AS us, count(*) AS n FROM fmod GROUP BY scan_us // 300000000", FS),
)

# --- resources -------------------------------------------------------------------------
add(
    "m19_cpu_baseline", lambda spark, sf: R.cpu_baseline(rs(spark, sf)).select("seq", r6("base_mean", "mean"), r6("base_std", "std")),
    sql("SELECT seq, round(mean, 6) AS mean, round(std, 6) AS std FROM rb", RS),
)
add(
    "m20_adaptive_threshold", lambda spark, sf: R.with_threshold(rs(spark, sf)).select("seq", r6("threshold", "threshold")),
    sql("SELECT seq, round(threshold, 6) AS threshold FROM rt", RS),
)
add("m21_sustained_cpu", lambda spark, sf: R.sustained(rs(spark, sf)).select("seq", F.col("is_sustained").cast("int").alias("hit")), sql("SELECT seq, CAST(sustained AS INTEGER) AS hit FROM rsus", RS))
add(
    "m22_abuse_events", lambda spark, sf: R.events(rs(spark, sf)).select("seq", us("ts"), "pid", "kind", "entity_id", "memory_mb", "cpu_pct"),
    sql(
        "SELECT seq, scan_us AS us, pid, kind, CASE kind WHEN 'cpu_abuse' THEN 'resource:cpu:' ELSE 'resource:mem:' END || pid AS entity_id, CASE WHEN kind = 'memory_abuse' THEN rss_bytes // 1048576 END AS memory_mb, "
        "CASE WHEN kind = 'cpu_abuse' THEN cpu_pct END AS cpu_pct FROM rev", RS,
    ),
)
_EXEMPT = " OR ".join(f"name LIKE '{p[:-1]}%'" if p.endswith("*") else f"name = '{p}'" for p in EXEMPT_PROCESSES)
add(
    "m23_exempt", lambda spark, sf: rs(spark, sf).select("seq", X.name_matches(F.col("name"), EXEMPT_PROCESSES).cast("int").alias("exempt")),
    sql(f"SELECT seq, CASE WHEN {_EXEMPT} THEN 1 ELSE 0 END AS exempt FROM rs", RS),
)


@query("m25_entity_ids", sql(
    "SELECT kind, entity_id, count(*) AS n FROM (SELECT 'new_process' AS kind, 'proc:' || pid || ':' || name AS entity_id FROM pnew WHERE NOT (" + _TRUSTED + ") "
    "UNION ALL SELECT 'spawn_loop', 'proc:spawn:' || ppid FROM sp WHERE spawn_count >= 10 UNION ALL SELECT kind, entity_id FROM nev UNION ALL SELECT 'file_modified', 'file:' || path FROM fmod "
    "UNION ALL SELECT kind, CASE kind WHEN 'cpu_abuse' THEN 'resource:cpu:' ELSE 'resource:mem:' END || pid FROM rev) GROUP BY kind, entity_id", PS, _SPAWN, NET, FS, RS,
))
def _entity_ids(spark, sf):
    """All monitors into one event table."""
    from hostwarden.sources.tables import conform_events

    parts = [
        P.new_process_events(ps(spark, sf)), P.spawn_loop_events(ps(spark, sf)), N.events(cs(spark, sf)), FM.events(fs(spark, sf)), R.events(rs(spark, sf)),
    ]
    out = conform_events(parts[0])
    for part in parts[1:]:
        out = out.unionByName(conform_events(part))
    return out.groupBy("kind", "entity_id").agg(F.count(F.lit(1)).alias("n"))


@query("r0_from_snapshots", sql(
    "SELECT kind, entity_id, count(*) AS n, count(*) AS keys FROM (SELECT 'new_process' AS kind, 'proc:' || pid || ':' || name AS entity_id FROM pnew WHERE NOT (" + _TRUSTED + ") "
    "UNION ALL SELECT 'spawn_loop', 'proc:spawn:' || ppid FROM sp WHERE spawn_count >= 10 UNION ALL SELECT kind, entity_id FROM nev UNION ALL SELECT 'file_modified', 'file:' || path FROM fmod "
    f"UNION ALL SELECT 'rapid_changes', 'file:rapid' FROM (SELECT DISTINCT scan_us // {MIN} FROM fmod) "
    "UNION ALL SELECT kind, CASE kind WHEN 'cpu_abuse' THEN 'resource:cpu:' ELSE 'resource:mem:' END || pid FROM rev) GROUP BY kind, entity_id", PS, _SPAWN, NET, FS, RS,
))
def _from_snapshots(spark, sf):
    """Snapshots through all monitors and the ungated scoring plan: every event comes out once, under its own key."""
    from hostwarden.plans.monitoring import monitored_events
    from hostwarden.plans.scoring import score_events

    scored = score_events(monitored_events(ps(spark, sf), cs(spark, sf), fs(spark, sf), rs(spark, sf)), gate=False)
    return scored.groupBy("kind", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("host_id", "seq").alias("keys"))


_PLAN = f"SELECT pid, seq, name, kind AS reason FROM ev WHERE kind IN ('cpu_abuse', 'memory_abuse', 'spawn_loop') AND pid > 0 AND name <> '' AND NOT ({_EXEMPT})"
add(
    "k7_response_plan_renice",
    lambda spark, sf: K.response_plan(ev(spark, sf), ResourceGuardConfig(action="renice")).select("pid", "seq", "name", "reason", "action", "nice"),
    with_ev(f"SELECT *, 'renice' AS action, 19 AS nice FROM ({_PLAN})"),
)
add(
    "k7_response_plan_kill", lambda spark, sf: K.response_plan(ev(spark, sf), ResourceGuardConfig(action="kill")).select("pid", "seq", "name", "reason", "action"),
    with_ev(
        "SELECT pid, seq, name, reason, 'kill' AS action FROM walk WHERE kept",
        f"due AS (SELECT p.*, e.us, row_number() OVER (PARTITION BY p.pid ORDER BY e.us, p.seq) AS rn FROM ({_PLAN}) p JOIN ev e USING (seq))",
        "walk AS (SELECT *, us AS begun, true AS kept FROM due WHERE rn = 1 UNION ALL SELECT d.*, CASE WHEN d.us - w.begun >= 5000000 THEN d.us ELSE w.begun END, d.us - w.begun >= 5000000 FROM walk w JOIN due d ON d.pid = w.pid AND d.rn = w.rn + 1)",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
