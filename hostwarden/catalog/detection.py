"""Heuristic rules, scalar functions and Sigma rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostwarden.catalog.base import (
    ENTROPY, NAMES, RULE_SQL, SEVERITY_LABEL_SQL, SEVERITY_SQL, add, ev, query, r6, us, with_ev, with_scored,
)
from hostwarden.functions import expr as X
from hostwarden.operators import heuristics as H, sigma as G
from hostwarden.sources import sample_tables as T
from hostwarden.sources.sigma_rules import rules_table, shipped_rules

RULES = shipped_rules()

# --- heuristics ---------------------------------------------------------------
IDS = {
    "suspicious_path": "h1", "name_mimicry": "h2", "unusual_hour": "h3", "privilege_escalation": "h4",
    "scripting_from_temp": "h5", "high_entropy_name": "h6", "suspicious_port": "h7", "high_connection_rate": "h8",
    "outbound_unusual": "h9", "port_scan": "h10", "critical_file_modified": "h11", "rapid_modifications": "h12",
    "cpu_abuse": "h13", "memory_abuse": "h14", "spawn_loop": "h15",
}


def _rule_query(rule: H.HeuristicRule):
    if rule.name == "unusual_hour":
        # Scaled time covers one hour only, so this rule runs on the original clock.
        return lambda spark, sf: T.telemetry(spark, sf, 1).select("seq", rule.column().alias("points"))
    return lambda spark, sf: ev(spark, sf).select("seq", rule.column().alias("points"))


for _rule in H.DEFAULT_RULES:
    _sql = RULE_SQL[_rule.name]
    if _rule.name == "unusual_hour":
        _sql = _sql.replace("(us //", "(raw_us //")
    if _rule.name == "high_entropy_name":
        _text = with_ev(f"SELECT seq, CAST({_sql} AS DOUBLE) AS points FROM ev LEFT JOIN names USING (name)", NAMES)
    else:
        _text = with_ev(f"SELECT seq, CAST({_sql} AS DOUBLE) AS points FROM ev")
    add(f"{IDS[_rule.name]}_{_rule.name}", _rule_query(_rule), _text)

add(
    "h0_heuristic_score", lambda spark, sf: H.score(ev(spark, sf)).select("seq", "heuristic_score"),
    with_scored("SELECT seq, heuristic_score FROM hs"),
)
add(
    "h0_explain_hits",
    lambda spark, sf: H.explain_hits(ev(spark, sf)).select("seq", F.explode("rule_hits").alias("h")).groupBy("h.rule").agg(
        F.count(F.lit(1)).alias("events"), F.sum("h.points").alias("points")
    ),
    with_scored(
        "SELECT rule, count(*) AS events, sum(points) AS points FROM ("
        + " UNION ALL ".join(f"SELECT '{n}' AS rule, CAST({s} AS DOUBLE) AS points FROM hs" for n, s in RULE_SQL.items())
        + ") WHERE points > 0 GROUP BY rule"
    ),
)
add(
    "h16_severity",
    lambda spark, sf: H.with_severity(H.score(ev(spark, sf)), "heuristic_score").select("seq", "severity", "severity_label"),
    with_scored(
        f"SELECT seq, {SEVERITY_SQL.format(s='heuristic_score')} AS severity, {SEVERITY_LABEL_SQL.format(s='heuristic_score')} AS severity_label FROM hs"
    ),
)
add(
    "h17_gate", lambda spark, sf: H.gate(H.score(ev(spark, sf))).select("seq", "kind", "heuristic_score"),
    with_scored("SELECT seq, kind, heuristic_score FROM ge"),
)
add(
    "u1_register_rule",
    lambda spark, sf: H.score(
        ev(spark, sf), H.register_rule(H.DEFAULT_RULES, "hosts_file", "filesystem", lambda: F.when(F.col("path") == "/etc/hosts", 12))
    ).select("seq", "heuristic_score"),
    with_scored("SELECT seq, heuristic_score + CASE WHEN path = '/etc/hosts' THEN 12 ELSE 0 END AS heuristic_score FROM hs"),
)

# --- scalar functions -----------------------------------------------------------
add(
    "f1_entropy",
    lambda spark, sf: ev(spark, sf).where("name is not null").select("seq", r6(X.entropy(F.col("name")), "entropy")),
    with_ev("SELECT seq, round(entropy, 6) AS entropy FROM ev JOIN names USING (name)", NAMES),
)
add(
    "f1_entropy_text",
    lambda spark, sf: spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").distinct().select(
        "doc_id", r6(X.entropy(F.col("text"), texts=True), "entropy")
    ),
    f"SELECT doc_id, round({ENTROPY.format(col='d.text')}, 6) AS entropy FROM (SELECT DISTINCT doc_id, text FROM documents) d",
)
add(
    "f2_name_match",
    lambda spark, sf: ev(spark, sf).select("seq", X.name_matches(F.col("name"), ["python*", "sudo", "x7*"]).cast("int").alias("hit")),
    with_ev("SELECT seq, CASE WHEN name LIKE 'python%' OR name = 'sudo' OR name LIKE 'x7%' THEN 1 ELSE 0 END AS hit FROM ev"),
)
add(
    "f3_labels",
    lambda spark, sf: ev(spark, sf).select(
        "seq", X.severity_label(F.col("seq") % 6).alias("severity_text"), X.state_label(F.col("seq") % 6).alias("state_text")
    ),
    with_ev(
        "SELECT seq, coalesce((['INFO','LOW','MEDIUM','HIGH','CRITICAL'])[seq % 6 + 1], 'UNKNOWN') AS severity_text, "
        "coalesce((['CLEAN','WATCHING','SUSPICIOUS','THREAT','BLOCKED'])[seq % 6 + 1], 'UNKNOWN') AS state_text FROM ev"
    ),
)
_LEVELS = "element_at(array('critical', 'high', 'medium', 'low', 'High', ''), cast(seq % 6 + 1 as int))"
add(
    "f4_level_bonus",
    lambda spark, sf: ev(spark, sf).select("seq", F.expr(_LEVELS).alias("lv")).select("seq", X.level_bonus(F.col("lv")).alias("bonus")),
    with_ev("SELECT seq, ([60.0, 40.0, 25.0, 10.0, 5.0, 5.0])[seq % 6 + 1]::DOUBLE AS bonus FROM ev"),
)
add(
    "f5_value_text",
    lambda spark, sf: ev(spark, sf).where("cpu_pct is not null").select(
        "seq", X.number_text(F.col("cpu_pct")).alias("whole"), X.number_text(F.col("cpu_pct") + 0.5).alias("half")
    ),
    with_ev("SELECT seq, CAST(CAST(cpu_pct AS BIGINT) AS VARCHAR) AS whole, CAST(cpu_pct + 0.5 AS VARCHAR) AS half FROM ev WHERE cpu_pct IS NOT NULL"),
)
add(
    "f6_expected_path_length",
    lambda spark, sf: ev(spark, sf).select("seq", r6(X.expected_path_length(F.col("seq") % 300), "c")),
    with_ev(
        "SELECT seq, round(CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 ELSE 2 * (ln(n - 1) + 0.5772156649) - 2 * (n - 1) / n END, 6) AS c "
        "FROM (SELECT seq, CAST(seq % 300 AS DOUBLE) AS n FROM ev)"
    ),
)


@query("f7_mean_stddev", with_ev(
    "SELECT pid, round(coalesce(avg(cpu_pct), 0), 6) AS mean, round(CASE WHEN count(cpu_pct) < 2 THEN 0 ELSE stddev_pop(cpu_pct) END, 6) AS std FROM ev GROUP BY pid"
))
def _mean_std(spark, sf):
    mean, std = X.mean_stddev(F.col("cpu_pct"))
    return ev(spark, sf).groupBy("pid").agg(r6(mean, "mean"), r6(std, "std"))


add(
    "f8_uptime_text",
    lambda spark, sf: ev(spark, sf).select("seq", X.uptime_text(F.col("seq") * 7 % 90000).alias("uptime")),
    with_ev(
        "SELECT seq, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm ' || (s % 60) || 's' "
        "WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS uptime FROM (SELECT seq, seq * 7 % 90000 AS s FROM ev)"
    ),
)
_NOW_US = 1704067200000000 + 5_400_000_000
add(
    "f9_relative_time",
    lambda spark, sf: ev(spark, sf).select("seq", X.relative_time(F.col("ts"), F.timestamp_micros(F.lit(_NOW_US))).alias("rel")),
    with_ev(
        f"SELECT seq, CASE WHEN d < 1000000 THEN 'now' WHEN d < 60000000 THEN (d // 1000000) || 's ago' WHEN d < 3600000000 THEN (d // 60000000) || 'm ago' "
        f"ELSE (d // 3600000000) || 'h ago' END AS rel FROM (SELECT seq, {_NOW_US} - us AS d FROM ev)"
    ),
)
add(
    "f10_display_text",
    lambda spark, sf: H.score(ev(spark, sf)).select(
        "seq", X.score_percent(F.col("heuristic_score") * 1.3 - 10).alias("pct"), X.short_id(F.concat("entity_id", F.lit(":"), "message")).alias("short_id"),
        X.anomaly_percent(F.col("heuristic_score") / 128).alias("anomaly_pct"), X.join_list(F.array("source", "kind")).alias("joined"),
    ),
    with_scored(
        "SELECT seq, CAST(least(greatest(trunc(heuristic_score * 1.3 - 10), 0), 100) AS INTEGER) AS pct, "
        "CASE WHEN strlen(entity_id || ':' || message) <= 30 THEN entity_id || ':' || message ELSE substr(entity_id || ':' || message, 1, 30) || '...' END AS short_id, "
        "CAST(trunc(heuristic_score / 128 * 100) AS INTEGER) AS anomaly_pct, source || ', ' || kind AS joined FROM hs"
    ),
)
add(
    "f11_sha256",
    lambda spark, sf: spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash")),
    "SELECT doc_id, sha256(text) AS hash FROM documents",
)

# --- Sigma rules -------------------------------------------------------------------
_SIGMA_SQL = {
    "sigma-001": "source = 'process' AND (lower(exe) LIKE '%/tmp/%' OR lower(exe) LIKE '%/var/tmp/%' OR lower(exe) LIKE '%/dev/shm/%')",
    "sigma-002": "source = 'process' AND lower(name) IN ('bash','sh','dash','zsh','python','python3','perl','ruby','nc','ncat','socat')",
    "sigma-003": "source = 'process' AND ((lower(name) = 'sshd' AND lower(exe) NOT LIKE '/usr/sbin/%') OR (lower(name) = 'systemd' AND lower(exe) NOT LIKE '/usr/lib/systemd/%'))",
    "sigma-004": "source = 'network' AND remote_port IN (4444, 5555, 6666, 8888, 9999, 1337)",
    "sigma-005": "source = 'network' AND remote_port IN (6667, 6697)",
    "sigma-006": "source = 'network' AND remote_port IN (3389, 5900)",
    "sigma-007": "source = 'filesystem' AND path = '/etc/shadow'",
    "sigma-008": "source = 'filesystem' AND path = '/etc/sudoers'",
    "sigma-009": "source = 'filesystem' AND path = '/etc/crontab'",
    "sigma-010": "source = 'filesystem' AND path = '/etc/ssh/sshd_config'",
    "sigma-011": "source = 'filesystem' AND path = '/etc/hosts'",
    "sigma-012": "source = 'filesystem' AND path = '/etc/passwd'",
    "sigma-013": "source = 'process' AND (name LIKE '%xmrig%' OR name LIKE '%minerd%' OR name LIKE '%cpuminer%' OR name LIKE '%cgminer%' OR name LIKE '%bfgminer%' OR name LIKE '%ethminer%' OR name LIKE '%stratum%')",
    "sigma-014": "source = 'network' AND remote_port = 22 AND (remote_addr LIKE '10.%' OR remote_addr LIKE '192.168.%' OR remote_addr LIKE '172.16.%' OR remote_addr LIKE '172.17.%' OR remote_addr LIKE '172.18.%')",
    "sigma-015": "source = 'process' AND name IN ('whoami','id','uname','hostname','ifconfig','ip','netstat','ss','lsof','ps','cat')",
    "sigma-016": "source = 'process' AND name IN ('wget','curl')",
    "sigma-017": "source = 'process' AND name = 'chmod'",
    "sigma-018": "source = 'network' AND remote_port IN (9050, 9150)",
    "sigma-019": "source = 'process' AND name IN ('gcc','g++','cc','make') AND (exe LIKE '%/tmp/%' OR exe LIKE '%/dev/shm/%')",
    "sigma-020": "source = 'process' AND name IN ('at','crontab')",
    "sigma-021": "source = 'resource' AND kind IN ('cpu_abuse','memory_abuse')",
    "sigma-022": "source = 'process' AND kind = 'spawn_loop'",
    "sigma-023": "source = 'process' AND name IN ('su','sudo','pkexec','runuser','newgrp')",
    "sigma-024": "source = 'network' AND kind = 'port_scan'",
    "sigma-025": "source = 'process' AND name IN ('bash','sh','python','python3','perl','ruby','node') AND (exe LIKE '%/tmp/%' OR exe LIKE '%/var/tmp/%' OR exe LIKE '%/dev/shm/%')",
}


def _sigma_query(rule):
    return lambda spark, sf: ev(spark, sf).select("seq", G.rule_column(rule).cast("int").alias("hit"))


for _r in RULES:
    add(
        _r["id"].replace("-", "_"), _sigma_query(_r),
        with_ev(f"SELECT seq, CASE WHEN {_SIGMA_SQL[_r['id']]} THEN 1 ELSE 0 END AS hit FROM ev"),
    )

BONUS = {r["id"]: G.bonus_of(r["level"]) for r in RULES}
SIGMA_LIST_SQL = "concat_ws('|', " + ", ".join(
    f"CASE WHEN {_SIGMA_SQL[r['id']]} THEN '{r['title']}' END" for r in RULES
) + ")"
SIGMA_BONUS_SQL = " + ".join(f"CASE WHEN {_SIGMA_SQL[r['id']]} THEN {BONUS[r['id']]} ELSE 0 END" for r in RULES)

add(
    "g10_level_bonus_sum", lambda spark, sf: G.evaluate(ev(spark, sf), RULES).select("seq", "sigma_bonus"),
    with_ev(f"SELECT seq, CAST({SIGMA_BONUS_SQL} AS DOUBLE) AS sigma_bonus FROM ev"),
)
add(
    "g11_matched_titles",
    lambda spark, sf: G.evaluate(ev(spark, sf), RULES).select("seq", F.concat_ws("|", "sigma_rules").alias("titles")),
    with_ev(f"SELECT seq, {SIGMA_LIST_SQL} AS titles FROM ev"),
)
add(
    "g12_rule_hits", lambda spark, sf: G.rule_hits(G.evaluate(ev(spark, sf), RULES)),
    with_ev("SELECT title, count(*) AS hits FROM (" + " UNION ALL ".join(
        f"SELECT '{r['title']}' AS title FROM ev WHERE {_SIGMA_SQL[r['id']]}" for r in RULES
    ) + ") GROUP BY title"),
)
add(
    "g12_rule_count",
    lambda spark, sf: ev(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("events")).crossJoin(
        rules_table(spark).agg(F.count(F.lit(1)).alias("rules"))
    ),
    with_ev(f"SELECT source, count(*) AS events, CAST({len(RULES)} AS BIGINT) AS rules FROM ev GROUP BY source"),
)


def _detect(name: str, detection: dict, where: str, category: str = "", precedence: bool = False) -> None:
    """A query for one construct of the rule language."""
    rule = {"id": name, "title": name, "level": "low", "category": category, "detection": detection}
    add(
        name,
        lambda spark, sf: ev(spark, sf).select("seq", G.rule_column(rule, precedence).cast("int").alias("hit")),
        with_ev(f"SELECT seq, CASE WHEN {where} THEN 1 ELSE 0 END AS hit FROM ev"),
    )


_detect("g1_field_mapping", {"selection": {"Image|startswith": "/TMP/", "ProcessName": "BASH"}}, "coalesce(exe LIKE '/tmp/%' AND name = 'bash', false)")
_detect("g1_envelope_fallback", {"selection": {"Kind": "CPU_abuse", "SOURCE": "resource"}}, "kind = 'cpu_abuse' AND source = 'resource'")
_detect("g2_source_gate", {"selection": {"name": "python3"}}, "name = 'python3' AND source = 'resource'", "resource_event")
_detect("g2_unknown_category", {"selection": {"name": "python3"}}, "coalesce(name = 'python3', false)", "dns_query")
_detect("g3_selection_list", {"selection": [{"name": "bash", "exe|contains": "/tmp/"}, {"remote_port": 443}]},
        "coalesce(name = 'bash' AND exe LIKE '%/tmp/%', false) OR coalesce(remote_port = 443, false)")
_detect("g4_numeric_value", {"selection": {"cpu_pct": [97.0, 85], "pid": 3}}, "coalesce(cpu_pct IN (97, 85) AND pid = 3, false)")
_detect("g4_bool_is_false", {"selection": {"name": True}}, "false")
_detect("g5_modifiers", {"selection": {"exe|endswith": "SH", "exe|contains": ["shm", "Cache"]}},
        "coalesce(exe LIKE '%sh' AND (exe LIKE '%shm%' OR exe LIKE '%cache%'), false)")
_detect("g5_unknown_modifier", {"selection": {"name|contains|all": ["bash", "*md"]}}, "coalesce(name = 'bash' OR name LIKE '%md', false)")
_detect("g6_regex", {"selection": {"exe|re": r"^/(usr|dev)/.*[0-9]$"}}, "coalesce(regexp_matches(exe, '^/(usr|dev)/.*[0-9]$'), false)")
_detect("g6_regex_rejected", {"selection": {"exe|re": r"(?=/tmp)/tmp"}}, "false")
_detect("g7_wildcard", {"selection": {"exe": "/*/*sh*d"}}, "coalesce(regexp_matches(exe, '^/[^/]*/') AND exe LIKE '/%/%sh%d', false)")
_detect("g7_wildcard_no_backtrack", {"selection": {"path": "*s"}}, "coalesce(path IS NOT NULL AND path LIKE '%s' AND strpos(path, 's') = strlen(path), false)")
_COND = {"a": {"source": "network"}, "b": {"remote_port": 22}, "c": {"kind": "cpu_abuse"}}
_A, _B, _C = "(source = 'network')", "coalesce(remote_port = 22, false)", "(kind = 'cpu_abuse')"
_detect("g8_and_or", {**_COND, "condition": "a and b or c"}, f"{_A} AND ({_B} OR {_C})")
_detect("g8_not_all", {**_COND, "condition": "not a and b"}, f"NOT ({_A} AND {_B})")
_detect("g8_parentheses", {**_COND, "condition": "(a and not b) or c"}, f"({_A} AND NOT {_B}) OR {_C}")
_detect("g8_unknown_name", {**_COND, "condition": "nope or c"}, _C)
_detect("g8_standard_precedence", {**_COND, "condition": "not a and b or c"}, f"((NOT {_A}) AND {_B}) OR {_C}", precedence=True)
_SEL = {"selection_x": {"name": "bash"}, "selection_y": {"exe|contains": "/tmp/"}, "other": {"kind": "port_scan"}}
_X, _Y = "coalesce(name = 'bash', false)", "coalesce(exe LIKE '%/tmp/%', false)"
_detect("g9_one_of", {**_SEL, "condition": "1 of selection*"}, f"{_X} OR {_Y}")
_detect("g9_all_of", {**_SEL, "condition": "all of selection*"}, f"{_X} AND {_Y}")
_detect("g9_of_them", {**_SEL, "condition": "1 of them"}, "false")


@query("s6_rule_folder", with_ev("SELECT title, count(*) AS hits FROM (" + " UNION ALL ".join(
    f"SELECT '{r['title']}' AS title FROM ev WHERE {_SIGMA_SQL[r['id']]}" for r in RULES
) + ") GROUP BY title"))
def _rule_folder(spark, sf):
    """Rules written as files through Spark, loaded by the folder source, and run over all events."""
    import uuid

    from hostwarden.session import configure, shared_dir
    from hostwarden.sources.sigma_rules import read_rules, rules_list, write_rules

    configure(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/rules-{uuid.uuid4().hex}"
    write_rules(spark, folder, RULES)
    return G.rule_hits(G.evaluate(ev(spark, sf), rules_list(read_rules(spark, folder, pattern="*.txt"))))
