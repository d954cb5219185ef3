"""The scoring pipeline, reports and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hostwarden.catalog.base import SEVERITY_LABEL_SQL, SEVERITY_SQL, add, ev, query, r6, us, with_scored, with_scored_recursive
from hostwarden.catalog.correlating import CORR, scored
from hostwarden.catalog.detection import RULES, SIGMA_BONUS_SQL, SIGMA_LIST_SQL
from hostwarden.catalog.enrichment import INTEL_BONUS_SQL, INTEL_JOIN, TABLES
from hostwarden.catalog.flagship import scored_events, scored_table
from hostwarden.catalog.learning import GATED_FEAT, forest_sql
from hostwarden.catalog.monitoring import PS, ps
from hostwarden.catalog.state import LOOP, SNAP, snapshot
from hostwarden.functions import expr as X
from hostwarden.operators import correlation as C
from hostwarden.plans import reports as R
from hostwarden.sources import sinks as K

_SIG_BONUS, _SIG_LIST = SIGMA_BONUS_SQL, SIGMA_LIST_SQL
R0 = f"""
r0a AS (SELECT e.*, {INTEL_BONUS_SQL} AS intel_bonus, {_SIG_BONUS.replace('lower(name)', 'lower(e.name)').replace('lower(exe)', 'lower(e.exe)')} AS sigma_bonus, {_SIG_LIST} AS sigma_rules,
          coalesce(g.country_code, '') AS country FROM corr e {INTEL_JOIN}),
r0 AS (SELECT *, {SEVERITY_SQL.format(s='score')} AS severity, {SEVERITY_LABEL_SQL.format(s='score')} AS severity_label
       FROM (SELECT *, heuristic_score * multiplier + pattern_bonus + intel_bonus + sigma_bonus AS score FROM r0a))"""


def piped(select: str, *ctes: str) -> str:
    return with_scored(select, CORR, TABLES, R0, *ctes)


def _cols() -> list:
    return [
        "seq", "multiplier", "related_count", F.concat_ws("|", "patterns").alias("patterns"),
        F.concat_ws("|", "sigma_rules").alias("sigma_rules"), "severity", "severity_label",
    ]


add(
    "r0_score_events",
    lambda spark, sf: scored_events(spark, sf, with_model=False).select(
        *_cols(), r6("intel_bonus", "intel_bonus"), r6("sigma_bonus", "sigma_bonus"), r6("score", "score")
    ),
    piped(
        "SELECT seq, CAST(multiplier AS DOUBLE) AS multiplier, related_count, patterns, sigma_rules, severity, severity_label, CAST(intel_bonus AS DOUBLE) AS intel_bonus, "
        "CAST(sigma_bonus AS DOUBLE) AS sigma_bonus, round(score, 6) AS score FROM r0"
    ),
)
_BONUS_SQL = "CASE WHEN anomaly_score > 0.95 THEN 50.0 WHEN anomaly_score > 0.85 THEN 30.0 WHEN anomaly_score > 0.7 THEN 15.0 ELSE 0.0 END"
R0_ANOMALY = f"""
r0n AS (SELECT *, {SEVERITY_SQL.format(s='score')} AS severity, {SEVERITY_LABEL_SQL.format(s='score')} AS severity_label
        FROM (SELECT r0a.*, anomaly_score, heuristic_score * multiplier + pattern_bonus + {_BONUS_SQL} + intel_bonus + sigma_bonus AS score FROM r0a JOIN g_anomaly USING (seq)))"""
add(
    "r0_with_anomaly", lambda spark, sf: scored_events(spark, sf).select(*_cols(), r6("anomaly_score", "anomaly_score"), r6("score", "score")),
    with_scored_recursive(
        "SELECT seq, CAST(multiplier AS DOUBLE) AS multiplier, related_count, patterns, sigma_rules, severity, severity_label, round(anomaly_score, 6) AS anomaly_score, round(score, 6) AS score FROM r0n",
        CORR, TABLES, R0, GATED_FEAT, forest_sql("g_feat", "g_"), R0_ANOMALY,
    ),
)


@query("r0_ungated", with_scored("SELECT seq, CAST(CASE WHEN source = 'process' AND name = 'whoami' THEN 1 ELSE 0 END AS INTEGER) AS enumeration, heuristic_score FROM hs WHERE source = 'process'"))
def _ungated(spark, sf):
    """Without the gate, the rules also see events that have no heuristic points."""
    from hostwarden.config import Config, CorrelatorConfig
    from hostwarden.plans.scoring import score_events

    out = score_events(ev(spark, sf), Config(correlator=CorrelatorConfig(enabled=False)), gate=False, staged=False)
    hit = F.array_contains("sigma_rules", "System Enumeration Tools")
    return out.where("source = 'process'").select("seq", hit.cast("int").alias("enumeration"), "heuristic_score")


add(
    "r1_recent_events", lambda spark, sf: R.recent_events(scored_table(spark, sf)).select("seq", us("ts"), r6("score", "score")),
    piped("SELECT seq, us, round(score, 6) AS score FROM r0 ORDER BY us DESC, seq DESC LIMIT 500"),
)


def loop(select: str, *ctes: str) -> str:
    return with_scored_recursive(select, LOOP, SNAP, *ctes)


add(
    "r2_entities", lambda spark, sf: snapshot(spark, sf).select("entity_id", "state_label", r6("score", "score"), "event_count"),
    loop("SELECT entity_id, (['CLEAN','WATCHING','SUSPICIOUS','THREAT','BLOCKED'])[state + 1] AS state_label, round(score, 6) AS score, event_count FROM snaps"),
)
_LEVEL = "CASE WHEN max(state) >= 3 THEN 'critical' WHEN max(state) >= 2 THEN 'high' WHEN max(state) >= 1 THEN 'elevated' ELSE 'safe' END"
add("r3_threat_level", lambda spark, sf: R.threat_level(snapshot(spark, sf)), loop(f"SELECT {_LEVEL} AS threat_level FROM snaps"))
add("r4_active_threats", lambda spark, sf: R.active_threats(snapshot(spark, sf)), loop("SELECT count(*) FILTER (state >= 2) AS active_threats FROM snaps"))
add(
    "r5_status",
    lambda spark, sf: R.status(scored(spark, sf), snapshot(spark, sf), ps(spark, sf), len(RULES), started="2024-01-01 00:00:00", now="2024-01-01 01:02:03").select(
        "uptime_seconds", "process_count", "files_watched", "total_events", "active_threats", "threat_level", "sigma_rules", F.col("learning").cast("int").alias("learning")
    ),
    loop(
        "SELECT 3723::BIGINT AS uptime_seconds, (SELECT count(DISTINCT pid) FROM ps WHERE scan_us = (SELECT max(scan_us) FROM ps)) AS process_count, 20 AS files_watched, (SELECT count(*) FROM ge) AS total_events, "
        f"(SELECT count(*) FILTER (state >= 2) FROM snaps) AS active_threats, (SELECT {_LEVEL} FROM snaps) AS threat_level, 25 AS sigma_rules, 0 AS learning", PS,
    ),
)


@query("r6_correlation_report", with_scored(
    "SELECT from_id, to_id, kind, pattern, count(*) AS edges FROM (SELECT e_seq, e_entity AS from_id, entity_id AS to_id, 'same_pid' AS kind, '' AS pattern FROM live WHERE entity_id <> e_entity "
    "UNION ALL SELECT e_seq, e_entity, entity_id, 'pattern', unnest(string_split(patterns, '|')) FROM live JOIN (SELECT seq, patterns FROM corr WHERE patterns <> '') c ON c.seq = e_seq WHERE live.entity_id <> e_entity) "
    "WHERE from_id IN (SELECT entity_id FROM ge WHERE pid = 7) OR to_id IN (SELECT entity_id FROM ge WHERE pid = 7) GROUP BY ALL", CORR,
))
def _report(spark, sf):
    events = scored(spark, sf)
    _, edges = R.correlation_report(events, C.correlate(events), 7, "heuristic_score")
    return edges.groupBy("from_id", "to_id", "kind", "pattern").agg(F.count(F.lit(1)).alias("edges"))


_NOW_US = 1704067200000000 + 5_400_000_000
_CLOCK = "strftime(make_timestamp(us), '%H:%M:%S')"
_RFC = "strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ')"
add(
    "r8_display_columns",
    lambda spark, sf: R.display(scored_table(spark, sf), F.timestamp_micros(F.lit(_NOW_US))).select(
        "seq", "score_pct", "anomaly_pct", "relative_time", "short_id", "clock", "severity_class", "pattern_text", "sigma_text", *[F.col(c).cast("int").alias(c) for c in ("has_patterns", "has_sigma")]
    ),
    piped(
        f"SELECT seq, CAST(least(trunc(score), 100) AS INTEGER) AS score_pct, 0 AS anomaly_pct, (({_NOW_US} - us) // 60000000) || 'm ago' AS relative_time, "
        "CASE WHEN strlen(entity_id) <= 30 THEN entity_id ELSE substr(entity_id, 1, 30) || '...' END AS short_id, "
        f"{_CLOCK} AS clock, lower(severity_label) AS severity_class, replace(patterns, '|', ', ') AS pattern_text, replace(sigma_rules, '|', ', ') AS sigma_text, CAST(patterns <> '' AS INTEGER) AS has_patterns, CAST(sigma_rules <> '' AS INTEGER) AS has_sigma FROM r0"
    ).replace(f"(({_NOW_US} - us) // 60000000) || 'm ago'", f"CASE WHEN {_NOW_US} - us >= 3600000000 THEN (({_NOW_US} - us) // 3600000000) || 'h ago' ELSE (({_NOW_US} - us) // 60000000) || 'm ago' END"),
)
add(
    "k1_alert_lines", lambda spark, sf: K.alert_lines(scored_table(spark, sf)),
    piped(
        f"SELECT '[' || {_RFC} || '] [' || severity_label || '] [' || source || '] ' || message || ' | entity=' || entity_id || ' score=' || printf('%.1f', score) "
        "|| CASE WHEN patterns <> '' THEN ' patterns=[' || replace(patterns, '|', ' ') || ']' ELSE '' END || CASE WHEN sigma_rules <> '' THEN ' sigma=[' || replace(sigma_rules, '|', ' ') || ']' ELSE '' END "
        "|| CASE WHEN multiplier > 1 THEN ' mult=' || printf('%.1f', multiplier) || 'x' ELSE '' END AS value FROM r0"
    ),
)
_DETAILS = {  # detail column: its name in the derived telemetry
    "pid": "pid", "name": "name", "exe": "exe", "remote_addr": "remote_addr", "remote_port": "remote_port", "count": "cnt", "unique_ports": "unique_ports", "child_count": "child_count", "path": "path",
    "prev_hash": "prev_hash", "new_hash": "new_hash", "prev_size": "prev_size", "new_size": "new_size", "cpu_pct": "cpu_pct", "memory_mb": "memory_mb",
}
_JSON_LISTS = "CASE WHEN patterns <> '' THEN to_json(string_split(patterns, '|'))::VARCHAR ELSE '[]' END AS patterns, CASE WHEN sigma_rules <> '' THEN to_json(string_split(sigma_rules, '|'))::VARCHAR ELSE '[]' END AS sigma_rules"
_INTEL_TEXT = "CAST(i_score AS VARCHAR) AS abuse_score, i_country AS geo_country, i_city AS geo_city, CASE WHEN i_pulses IS NOT NULL THEN CAST(i_pulses AS VARCHAR) END AS pulses, CASE WHEN strlen(new_hash) = 64 THEN CASE WHEN i_malware THEN 'true' ELSE 'false' END END AS known_malware"
#: What the intel providers say about every event.
SAID = f"said AS (SELECT e.seq, CASE WHEN e.us < a.expires THEN a.abuse_score END AS i_score, g.country_code AS i_country, g.city AS i_city, CASE WHEN e.us < o.expires THEN o.pulse_count END AS i_pulses, m.sha256 IS NOT NULL AS i_malware FROM corr e {INTEL_JOIN})"


def _strings(*names: str, **nested: str) -> str:
    """The type of a JSON object: texts (numbers and arrays as they are written), and objects."""
    return ", ".join([*[f"{c} string" for c in names], *[f"{c} struct<{ddl}>" for c, ddl in nested.items()]])


def _read(rows: DataFrame, column: str, ddl: str) -> DataFrame:
    """Every row's text read once, however many of its fields are asked for."""
    return rows.select("seq", F.from_json(column, ddl).alias("j"))


_NUMBERS = ("score", "anomaly_score", "multiplier")
_FEED = ("time", "severity", "label", "source", "message", "entity", "patterns", "sigma_rules", "country")
_PAYLOAD = _strings(
    "timestamp", "severity", "source", "kind", "entity_id", "message", "patterns", "sigma_rules", *_NUMBERS, details=_strings(*_DETAILS),
    threat_intel=_strings(abuseipdb="abuse_score string", geoip=_strings("country_code", "city"), otx="pulse_count string", malware_check="known_malware string"),
)
add(
    "k2_webhook_payloads",
    lambda spark, sf: _read(K.webhook_payloads(scored_table(spark, sf)), "payload", _PAYLOAD).select(
        "seq", *[f"j.{c}" for c in ("timestamp", "severity", "source", "kind", "entity_id", "message", "patterns", "sigma_rules")],
        *[F.col(f"j.{c}").cast("double").alias(c) for c in _NUMBERS],
        *[F.col(f"j.details.{c}").alias(f"d_{c}") for c in _DETAILS if c != "cpu_pct"], F.col("j.details.cpu_pct").cast("double").alias("d_cpu_pct"),
        "j.threat_intel.abuseipdb.abuse_score", F.col("j.threat_intel.geoip.country_code").alias("geo_country"), F.col("j.threat_intel.geoip.city").alias("geo_city"),
        F.col("j.threat_intel.otx.pulse_count").alias("pulses"), "j.threat_intel.malware_check.known_malware",
    ),
    piped(
        f"SELECT seq, {_RFC} AS timestamp, severity_label AS severity, source, kind, entity_id, message, {_JSON_LISTS}, round(score, 6) AS score, 0.0::DOUBLE AS anomaly_score, coalesce(multiplier, 0)::DOUBLE AS multiplier, "
        + ", ".join(f"CAST({old} AS {'DOUBLE' if new == 'cpu_pct' else 'VARCHAR'}) AS d_{new}" for new, old in _DETAILS.items()) + f", {_INTEL_TEXT} FROM r0 JOIN said USING (seq) WHERE severity >= 2", SAID
    ),
)
add(
    "k3_notifications", lambda spark, sf: K.notifications(scored_table(spark, sf)).select("seq", "title", "body", "urgency"),
    piped(
        "SELECT seq, 'Security alert [' || severity_label || ']' AS title, message || CASE WHEN patterns <> '' THEN ' | Patterns: ' || replace(patterns, '|', ', ') ELSE '' END "
        "|| CASE WHEN sigma_rules <> '' THEN ' | Sigma: ' || replace(sigma_rules, '|', ', ') ELSE '' END || CASE WHEN country <> '' THEN ' | Country: ' || country ELSE '' END AS body, "
        "CASE WHEN severity >= 4 THEN 'critical' ELSE 'normal' END AS urgency FROM r0 WHERE severity >= 3"
    ),
)
add(
    "k4_live_feed",
    lambda spark, sf: _read(K.feed(scored_table(spark, sf)), "data", _strings(*_FEED, *_NUMBERS)).select(
        "seq", *[f"j.{c}" for c in _FEED], *[F.col(f"j.{c}").cast("double").alias(c) for c in _NUMBERS],
    ),
    piped(
        f"SELECT seq, {_CLOCK} AS time, lower(severity_label) AS severity, severity_label AS label, source, message, entity_id AS entity, {_JSON_LISTS}, nullif(country, '') AS country, "
        "round(score, 6) AS score, 0.0::DOUBLE AS anomaly_score, coalesce(multiplier, 0)::DOUBLE AS multiplier FROM r0"
    ),
)
add(
    "k9_console_lines", lambda spark, sf: K.console_lines(scored_table(spark, sf)),
    piped("SELECT '[' || strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') || '] [' || rpad(severity_label, 8, ' ') || '] ' || message AS value FROM r0"),
)
