"""Table schemas, as DDL strings."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns an event may carry besides its envelope, in schema order.
DETAIL_COLUMNS = (
    "pid", "name", "exe", "cmdline", "parent_exe", "user", "created",
    "remote_addr", "remote_port", "local_port", "count", "unique_ports", "child_count", "window_sec",
    "path", "prev_hash", "new_hash", "prev_size", "new_size",
    "cpu_pct", "threshold", "sustained_sec", "memory_mb",
)

EVENT_DDL = (
    "host_id string, seq bigint, ts timestamp, source string, kind string, entity_id string, message string, "
    "pid int, name string, exe string, cmdline string, parent_exe string, user string, created string, "
    "remote_addr string, remote_port int, local_port int, count int, unique_ports int, child_count int, window_sec int, "
    "path string, prev_hash string, new_hash string, prev_size bigint, new_size bigint, "
    "cpu_pct double, threshold double, sustained_sec int, memory_mb bigint, extra map<string,string>"
)
PROCESS_SNAPSHOT_DDL = (
    "host_id string, scan_ts timestamp, seq bigint, pid int, name string, exe string, created timestamp, ppid int"
)
CONNECTION_SNAPSHOT_DDL = (
    "host_id string, scan_ts timestamp, seq bigint, pid int, status string, "
    "local_port int, remote_addr string, remote_port int"
)
FILE_SNAPSHOT_DDL = (
    "host_id string, scan_ts timestamp, path string, hash string, mtime timestamp, size bigint"
)
RESOURCE_SAMPLE_DDL = (
    "host_id string, scan_ts timestamp, seq bigint, pid int, name string, exe string, "
    "cpu_pct double, rss_bytes bigint"
)
RULES_DDL = (
    "title string, id string, status string, level string, category string, product string, "
    "detection string, tags array<string>, file string"
)
INTEL_ABUSE_DDL = (
    "ip string, abuse_score double, country string, total_reports int, "
    "is_whitelisted boolean, isp string, expires timestamp"
)
INTEL_GEO_DDL = "ip_from string, ip_to string, country_code string, country string, city string"
INTEL_OTX_DDL = "ip string, pulse_count int, pulses array<string>, tags array<string>, expires timestamp"
INTEL_MALWARE_DDL = "sha256 string, family string, tags array<string>, file_type string, first_seen string"
FEEDBACK_DDL = "entity_id string, rule_name string, false_positive boolean, ts timestamp"
MODEL_NODE_DDL = (
    "tree_id int, node_id int, attr int, split double, left int, right int, size bigint, depth int"
)

FEATURES = ("conn_per_min", "unique_ips", "unique_ports_f", "avg_interval", "proc_per_min", "file_mods_per_min")


def struct(ddl: str) -> T.StructType:
    """Parse a DDL string into a ``StructType``."""
    return T._parse_datatype_string(ddl)
