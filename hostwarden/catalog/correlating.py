"""Correlation, patterns, graph and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostwarden.catalog.base import RULE_SQL, add, ev, query, r6, us, with_ev, with_scored
from hostwarden.functions import expr as X
from hostwarden.operators import correlation as C, feedback as B, graph as G, heuristics as H, patterns as P
from hostwarden.sources import sample_tables as T

WINDOW = 60_000_000
SLICE = 300_000_000
KEEP = 600_000_000


def scored(spark, sf):
    """Events that passed the gate."""
    return H.gate(H.score(ev(spark, sf)))


# Latest event per entity of the same pid within the window, for every event (itself included).
LIVE = f"""
cand AS (SELECT e.seq AS e_seq, e.us AS e_us, e.pid AS e_pid, e.entity_id AS e_entity, n.*,
           row_number() OVER (PARTITION BY e.seq, n.entity_id ORDER BY n.us DESC, n.seq DESC) AS rn
         FROM ge e JOIN ge n ON e.pid = n.pid AND (n.us < e.us OR (n.us = e.us AND n.seq <= e.seq)) AND n.us > e.us - {WINDOW}),
live AS (SELECT * FROM cand WHERE rn = 1)"""
SOURCES = f"""
src AS (SELECT e.seq, count(DISTINCT n.source) AS source_count FROM ge e JOIN ge n
          ON e.pid = n.pid AND (n.us < e.us OR (n.us = e.us AND n.seq <= e.seq)) AND n.us >= e.us // {SLICE} * {SLICE} - {KEEP}
        GROUP BY e.seq)"""
TESTS = {
    "reverse_shell": "count(*) FILTER (source = 'process' AND (exe LIKE '%/tmp/%' OR exe LIKE '%/var/tmp/%' OR exe LIKE '%/dev/shm/%' OR exe LIKE '%/.cache/%' OR exe LIKE '%/Downloads/%')) > 0 "
    "AND count(*) FILTER (source = 'network' AND remote_port IN (4444,5555,6666,8888,9999,1337)) > 0",
    "data_exfiltration": "count(*) FILTER (source = 'process') > 0 AND count(*) FILTER (source = 'network' AND cnt > 20) > 0 "
    "AND count(*) FILTER (source = 'filesystem' AND path IN ('/etc/shadow','/etc/passwd','/etc/sudoers')) > 0",
    "persistence": "count(*) FILTER (source = 'process') > 0 AND count(*) FILTER (source = 'filesystem' AND path IN ('/etc/crontab','/etc/ssh/sshd_config','/etc/sudoers')) > 0",
    "lateral_movement": "count(*) FILTER (source = 'process') > 0 AND count(*) FILTER (source = 'network' AND remote_port = 22 AND "
    "(remote_addr LIKE '10.%' OR remote_addr LIKE '192.168.%' OR remote_addr LIKE '172.16.%' OR remote_addr LIKE '172.17.%' OR remote_addr LIKE '172.18.%' "
    "OR remote_addr LIKE '172.19.%' OR remote_addr LIKE '172.2%' OR remote_addr LIKE '172.30.%' OR remote_addr LIKE '172.31.%')) > 0",
    "crypto_miner": "count(*) FILTER (source = 'process' AND bytes > 8 AND entropy > 3.5) > 0 AND count(*) FILTER (source = 'network') > 0",
    "beaconing": "false",
    "runaway_fork": "count(*) FILTER (source = 'process' AND child_count IS NOT NULL) > 0 AND count(*) FILTER (source = 'resource' AND cpu_pct IS NOT NULL) > 0",
    "ssh_brute_force": "count(*) FILTER (source = 'network' AND remote_port = 22) >= 5",
}
POINTS = {p.name: p.bonus for p in P.DEFAULT_PATTERNS}
# (pid, address) histories for the beacon test, as of any event time.
BEACONS = f"""
net AS (SELECT * FROM ge WHERE source = 'network' AND remote_addr IS NOT NULL AND remote_addr <> ''),
bl AS (SELECT DISTINCT e_seq, e_us, e_pid, remote_addr FROM live WHERE source = 'network' AND remote_addr <> ''),
bh AS (SELECT bl.e_seq, bl.remote_addr, n.us, n.seq, row_number() OVER (PARTITION BY bl.e_seq, bl.remote_addr ORDER BY n.us DESC, n.seq DESC) AS rn
       FROM bl JOIN net n ON n.pid = bl.e_pid AND n.remote_addr = bl.remote_addr AND (n.us < bl.e_us OR (n.us = bl.e_us AND n.seq <= bl.e_seq))
         AND n.us > bl.e_us // {SLICE} * {SLICE} - {KEEP}),
bg AS (SELECT *, (us - lag(us) OVER (PARTITION BY e_seq, remote_addr ORDER BY us, seq)) / 1000000.0 AS gap FROM bh WHERE rn <= 20),
bb AS (SELECT e_seq, remote_addr FROM bg GROUP BY e_seq, remote_addr HAVING count(*) >= 5 AND avg(gap) >= 1 AND stddev_pop(gap) < avg(gap) * 0.15),
beac AS (SELECT DISTINCT e_seq FROM bb)"""
PAT = f"""
pf AS (SELECT e_seq, count(*) - 1 AS related_count, {', '.join(f'({t}) AS t_{n}' for n, t in TESTS.items() if n != 'beaconing')} FROM live GROUP BY e_seq),
corr AS (SELECT g.*, s.source_count, CASE WHEN s.source_count >= 3 THEN 2.5 WHEN s.source_count >= 2 THEN 1.5 ELSE 1.0 END AS multiplier, pf.related_count,
           concat_ws('|', {', '.join(f"CASE WHEN {'b.e_seq IS NOT NULL' if n == 'beaconing' else 't_' + n} THEN '{n}' END" for n in TESTS)}) AS patterns,
           {' + '.join(f"CASE WHEN {'b.e_seq IS NOT NULL' if n == 'beaconing' else 't_' + n} THEN {POINTS[n]} ELSE 0 END" for n in TESTS)} AS pattern_bonus
         FROM ge g JOIN src s USING (seq) JOIN pf ON pf.e_seq = g.seq LEFT JOIN beac b ON b.e_seq = g.seq)"""
CORR = ",".join([LIVE, SOURCES, BEACONS, PAT])

add(
    "c1_pid_split",
    lambda spark, sf: C.correlate(scored(spark, sf).withColumn("pid", F.when(F.col("seq") % 4 != 0, F.col("pid")))).where("pid is null").select(
        "seq", "multiplier", r6(C.effective_score(F.col("heuristic_score")), "score")
    ),
    with_scored("SELECT seq, CAST(NULL AS DOUBLE) AS multiplier, round(heuristic_score, 6) AS score FROM ge WHERE seq % 4 = 0"),
)
add(
    "c2_nodes",
    lambda spark, sf: G.nodes(scored(spark, sf), "heuristic_score").select("entity_id", "source", "pid", "score", us("last_seen")),
    with_scored(
        "SELECT entity_id, source, pid, heuristic_score AS score, us FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY us DESC, seq DESC) AS rn FROM ge) WHERE rn = 1"
    ),
)
add(
    "c3_pid_members", lambda spark, sf: G.pid_members(scored(spark, sf)).select("pid", "entity_id"),
    with_scored("SELECT DISTINCT pid, entity_id FROM ge WHERE pid <> 0"),
)
PAIRS_SQL = with_scored("SELECT e_seq AS seq, e_entity AS entity_id, entity_id AS related_id FROM live WHERE entity_id <> e_entity", LIVE)
add("c4_related_pairs", lambda spark, sf: C.related_pairs(scored(spark, sf)).select("seq", "entity_id", "related_id"), PAIRS_SQL)
add(
    "c5_correlated_with",
    lambda spark, sf: C.correlated_with(scored(spark, sf)).select("seq", F.concat_ws("|", "correlated_with").alias("related")),
    with_scored(
        "SELECT g.seq, coalesce(r.related, '') AS related FROM ge g LEFT JOIN (SELECT e_seq, string_agg(entity_id, '|' ORDER BY entity_id) AS related "
        "FROM live WHERE entity_id <> e_entity GROUP BY e_seq) r ON r.e_seq = g.seq", LIVE,
    ),
)
add(
    "c6_source_count", lambda spark, sf: C.correlate(scored(spark, sf)).select("seq", F.col("source_count").cast("int").alias("source_count")),
    with_scored("SELECT seq, source_count FROM src", SOURCES),
)
add(
    "c7_multiplier", lambda spark, sf: C.correlate(scored(spark, sf)).select("seq", "multiplier"),
    with_scored("SELECT seq, CASE WHEN source_count >= 3 THEN 2.5 WHEN source_count >= 2 THEN 1.5 ELSE 1.0 END AS multiplier FROM src", SOURCES),
)
add(
    "c8_correlated_score",
    lambda spark, sf: C.correlate(scored(spark, sf)).select(
        "seq", "related_count", F.concat_ws("|", "patterns").alias("patterns"), "pattern_bonus", r6(C.effective_score(F.col("heuristic_score")), "score")
    ),
    with_scored(
        "SELECT seq, related_count, patterns, CAST(pattern_bonus AS DOUBLE) AS pattern_bonus, round(heuristic_score * multiplier + pattern_bonus, 6) AS score FROM corr", CORR
    ),
)


# Few busy pids on few addresses, so that beacons and brute force occur.
def busy(spark, sf):
    rows = T.ingested(spark, sf, "connection_snapshots").groupBy("host_id", "scan_ts", "pid", "remote_addr").agg(F.min("seq").alias("seq"))
    from hostwarden.sources.tables import conform_events

    return conform_events(rows.select(
        "host_id", "seq", F.col("scan_ts").alias("ts"), F.lit("network").alias("source"), F.lit("new_outbound").alias("kind"),
        F.concat(F.lit("net:"), "remote_addr", F.lit(":22")).alias("entity_id"), F.lit("x").alias("message"), "pid", "remote_addr",
        F.lit(22).alias("remote_port"),
    )).withColumn("heuristic_score", F.lit(5.0))


CONN = """
cn AS (SELECT us - us % 60000000 AS scan_us, event_id AS seq, CAST(user_id % 3 + 1 AS INTEGER) AS pid,
         CASE WHEN k % 10 < 7 THEN 'ESTABLISHED' WHEN k % 10 < 9 THEN 'SYN_SENT' ELSE 'LISTEN' END AS status,
         CAST(40000 + event_id % 2 AS INTEGER) AS local_port,
         CASE WHEN k = 7 THEN '127.0.0.1' ELSE (['10.0.0.', '192.168.1.', '8.8.8.', '172.20.0.'])[event_id % 4 + 1] || CAST(k % 2 AS VARCHAR) END AS remote_addr,
         CAST(CASE WHEN event_id % 3 = 0 THEN ([4444, 22, 443, 9050, 6667, 3389, 5555, 80])[k % 8 + 1] ELSE 1000 + event_id % 40 END AS INTEGER) AS remote_port
       FROM k0 WHERE event_type IN ('click', 'purchase'))"""
_BUSY = CONN + """,
ge AS (SELECT scan_us AS us, pid, remote_addr, min(seq) AS seq, 'network' AS source, 'net:' || remote_addr || ':22' AS entity_id, 22 AS remote_port,
         NULL::VARCHAR AS exe, NULL::BIGINT AS cnt, NULL::VARCHAR AS path, NULL::BIGINT AS bytes, NULL::DOUBLE AS entropy, NULL::BIGINT AS child_count,
         NULL::DOUBLE AS cpu_pct, 5.0 AS heuristic_score FROM cn GROUP BY ALL)"""
add(
    "c9_beacon_history",
    lambda spark, sf: C.beacon_flags(busy(spark, sf)).select("seq", "pid", "remote_addr", F.col("beacon_now").cast("int").alias("beacon")),
    with_ev(
        "SELECT n.seq, n.pid, n.remote_addr, CASE WHEN f.seq IS NULL THEN 0 ELSE 1 END AS beacon FROM ge n LEFT JOIN ok f USING (seq, pid, remote_addr)",
        _BUSY,
        f"h AS (SELECT e.seq, e.pid, e.remote_addr, n.us, n.seq AS n_seq, row_number() OVER (PARTITION BY e.seq, e.pid, e.remote_addr ORDER BY n.us DESC, n.seq DESC) AS rn "
        f"FROM ge e JOIN ge n ON e.pid = n.pid AND e.remote_addr = n.remote_addr AND (n.us < e.us OR (n.us = e.us AND n.seq <= e.seq)) AND n.us > e.us // {SLICE} * {SLICE} - {KEEP})",
        "g AS (SELECT *, (us - lag(us) OVER (PARTITION BY seq, pid, remote_addr ORDER BY us, n_seq)) / 1000000.0 AS gap FROM h WHERE rn <= 20)",
        "ok AS (SELECT seq, pid, remote_addr FROM g GROUP BY ALL HAVING count(*) >= 5 AND avg(gap) >= 1 AND stddev_pop(gap) < avg(gap) * 0.15)".replace("GROUP BY ALL", "GROUP BY seq, pid, remote_addr"),
    ),
)
add(
    "c10_beacon_test",
    lambda spark, sf: busy(spark, sf).groupBy("pid", "remote_addr").agg(
        F.max_by(F.lit(1), "ts").alias("one"), F.array_sort(F.collect_set(X.micros("ts"))).alias("t")
    ).select("pid", "remote_addr", F.size("t").alias("n"), C.is_regular(F.slice("t", -20, 20)).cast("int").alias("beacon")).where("n >= 5"),
    with_ev(
        "SELECT pid, remote_addr, max(n) AS n, CASE WHEN avg(gap) >= 1 AND stddev_pop(gap) < avg(gap) * 0.15 THEN 1 ELSE 0 END AS beacon FROM "
        "(SELECT *, (us - lag(us) OVER (PARTITION BY pid, remote_addr ORDER BY us)) / 1000000.0 AS gap FROM "
        "(SELECT pid, remote_addr, us, count(*) OVER (PARTITION BY pid, remote_addr) AS n, row_number() OVER (PARTITION BY pid, remote_addr ORDER BY us DESC) AS rn "
        "FROM (SELECT DISTINCT pid, remote_addr, us FROM ge)) WHERE rn <= 20) WHERE n >= 5 GROUP BY pid, remote_addr", _BUSY,
    ),
)
BEACON_SQL = with_ev(
    "SELECT seq, pid, CASE WHEN patterns LIKE '%beaconing%' THEN 1 ELSE 0 END AS hit, CASE WHEN patterns LIKE '%ssh_brute_force%' THEN 1 ELSE 0 END AS ssh FROM corr",
    _BUSY, LIVE, SOURCES, BEACONS, PAT,
)
add(
    "p6_beaconing",
    lambda spark, sf: C.correlate(busy(spark, sf)).select(
        "seq", "pid", F.array_contains("patterns", "beaconing").cast("int").alias("hit"), F.array_contains("patterns", "ssh_brute_force").cast("int").alias("ssh")
    ),
    BEACON_SQL,
)
for _id, _name in (
    ("p1", "reverse_shell"), ("p2", "data_exfiltration"), ("p3", "persistence"), ("p4", "lateral_movement"), ("p5", "crypto_miner"), ("p7", "runaway_fork"), ("p8", "ssh_brute_force"),
):
    add(
        f"{_id}_{_name}",
        lambda spark, sf, n=_name: C.correlate(
            scored(spark, sf), patterns=[p for p in P.DEFAULT_PATTERNS if p.name == n]
        ).select("seq", F.array_contains("patterns", n).cast("int").alias("hit")),
        with_scored(f"SELECT e_seq AS seq, CASE WHEN {TESTS[_name]} THEN 1 ELSE 0 END AS hit FROM live GROUP BY e_seq", LIVE),
    )
add(
    "u2_register_pattern",
    lambda spark, sf: C.correlate(scored(spark, sf), patterns=P.register_pattern(
        (), "two_files", 7.0, {"file": lambda: F.col("source") == "filesystem"}, lambda live: live["file"] >= 2
    )).select("seq", "pattern_bonus"),
    with_scored("SELECT e_seq AS seq, CASE WHEN count(*) FILTER (source = 'filesystem') >= 2 THEN 7.0 ELSE 0.0 END AS pattern_bonus FROM live GROUP BY e_seq", LIVE),
)
add(
    "c11_same_pid_edges", lambda spark, sf: G.same_pid_edges(scored(spark, sf)).select("seq", "from_id", "to_id", "kind", us("created")),
    with_scored("SELECT e_seq AS seq, e_entity AS from_id, entity_id AS to_id, 'same_pid' AS kind, e_us AS us FROM live WHERE entity_id <> e_entity", LIVE),
)
_PEDGE = "SELECT e_seq AS seq, e_entity AS from_id, entity_id AS to_id, unnest(string_split(patterns, '|')) AS pattern FROM live JOIN (SELECT seq, patterns FROM corr WHERE patterns <> '') c ON c.seq = e_seq WHERE live.entity_id <> e_entity"
add(
    "c12_pattern_edges",
    lambda spark, sf: G.pattern_edges(scored(spark, sf), C.correlate(scored(spark, sf))).select("seq", "from_id", "to_id", "pattern"),
    with_scored(_PEDGE, CORR),
)
_PRUNE_AT = 1704067200000000 + 3_300_000_000
_EDGES = "edges AS (SELECT DISTINCT e_entity AS from_id, entity_id AS to_id FROM live WHERE entity_id <> e_entity)"
_NODES = "nodes AS (SELECT entity_id, max(us) AS us FROM ge GROUP BY entity_id)"


@query("c13_prune_edges", with_scored(
    f"SELECT from_id, to_id FROM edges WHERE from_id IN (SELECT entity_id FROM nodes WHERE us >= {_PRUNE_AT - KEEP}) AND to_id IN (SELECT entity_id FROM nodes WHERE us >= {_PRUNE_AT - KEEP})",
    LIVE, _EDGES, _NODES,
))
def _prune(spark, sf):
    events = scored(spark, sf)
    return G.live_edges(events, F.timestamp_micros(F.lit(_PRUNE_AT)), "heuristic_score").select("from_id", "to_id").distinct()


# The walk starts from one entity, as a report request does: the first spawning process by name.
_STARTS = "entity_id = (SELECT min(entity_id) FROM ge WHERE entity_id LIKE 'proc:spawn:%')"


@query("c14_related_to", with_scored(
    "SELECT start_id, entity_id, hop FROM reach WHERE hop > 0", LIVE, _EDGES,
    "both_ways AS (SELECT from_id AS a, to_id AS b FROM edges UNION SELECT to_id, from_id FROM edges)",
    f"s0 AS (SELECT DISTINCT entity_id AS start_id, entity_id, 0 AS hop FROM ge WHERE {_STARTS})",
    "s1 AS (SELECT * FROM s0 UNION ALL SELECT DISTINCT start_id, b, 1 FROM s0 JOIN both_ways ON a = entity_id WHERE (start_id, b) NOT IN (SELECT (start_id, entity_id) FROM s0))",
    "s2 AS (SELECT * FROM s1 UNION ALL SELECT DISTINCT start_id, b, 2 FROM s1 JOIN both_ways ON a = entity_id WHERE hop = 1 AND (start_id, b) NOT IN (SELECT (start_id, entity_id) FROM s1))",
    "reach AS (SELECT * FROM s2 UNION ALL SELECT DISTINCT start_id, b, 3 FROM s2 JOIN both_ways ON a = entity_id WHERE hop = 2 AND (start_id, b) NOT IN (SELECT (start_id, entity_id) FROM s2))",
))
def _related_to(spark, sf):
    events = scored(spark, sf)
    starts = events.where(F.col("entity_id").startswith("proc:spawn:")).groupBy("host_id").agg(F.min("entity_id").alias("entity_id"))
    return G.related_to(events, G.nodes(events, "heuristic_score"), starts).select("start_id", "entity_id", "hop")


@query("c15_pid_snapshot", with_scored(
    "SELECT from_id, to_id, count(*) AS edges FROM live0 WHERE from_id IN (SELECT entity_id FROM ge WHERE pid = 7) OR to_id IN (SELECT entity_id FROM ge WHERE pid = 7) GROUP BY from_id, to_id",
    LIVE, "live0 AS (SELECT e_entity AS from_id, entity_id AS to_id FROM live WHERE entity_id <> e_entity)",
))
def _pid_snapshot(spark, sf):
    events = scored(spark, sf)
    _, edges = G.for_pid(events, 7, "heuristic_score")
    return edges.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("edges"))


_PRIVATE = (
    "remote_addr LIKE '10.%' OR remote_addr LIKE '192.168.%' OR remote_addr LIKE '172.16.%' OR remote_addr LIKE '172.17.%' OR remote_addr LIKE '172.18.%' "
    "OR remote_addr LIKE '172.19.%' OR remote_addr LIKE '172.2%' OR remote_addr LIKE '172.30.%' OR remote_addr LIKE '172.31.%'"
)
add(
    "c16_private_ip",
    lambda spark, sf: ev(spark, sf).where("remote_addr is not null").select(
        "seq", X.is_private_ip(F.col("remote_addr")).cast("int").alias("private"), X.is_private_ip(F.col("remote_addr"), True).cast("int").alias("strict")
    ),
    with_ev(
        f"SELECT seq, CASE WHEN {_PRIVATE} THEN 1 ELSE 0 END AS private, CASE WHEN regexp_matches(remote_addr, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') THEN 1 ELSE 0 END AS strict "
        "FROM ev WHERE remote_addr IS NOT NULL"
    ),
)

# --- feedback ------------------------------------------------------------------
FEEDBACK = """
fbk AS (SELECT entity_id, us, CASE kind WHEN 'new_process' THEN 'suspicious_path' WHEN 'suspicious_port' THEN 'suspicious_port' WHEN 'file_modified' THEN 'critical_file_modified'
          WHEN 'cpu_abuse' THEN 'cpu_abuse' ELSE kind END AS rule_name, seq % 3 = 0 AS fp FROM ev)"""
_STATS = "SELECT rule_name, count(*) AS total, CAST(sum(CASE WHEN fp THEN 0 ELSE 1 END) AS BIGINT) AS true_positives, CAST(sum(CASE WHEN fp THEN 1 ELSE 0 END) AS BIGINT) AS false_positives FROM fbk GROUP BY rule_name"
add("b1_feedback_counts", lambda spark, sf: B.stats(T.feedback(ev(spark, sf))), with_ev(_STATS, FEEDBACK))
add("r7_feedback_report", lambda spark, sf: B.stats(T.feedback(ev(spark, sf))).orderBy("rule_name"), with_ev(_STATS + " ORDER BY rule_name", FEEDBACK))
add(
    "b2_effective_weight",
    lambda spark, sf: B.effective_weights(
        ev(spark, sf).select(F.explode(F.array("kind", F.concat("source", F.lit("_none")))).alias("rule_name")).distinct().withColumn("base_weight", F.lit(100.0)),
        B.stats(T.feedback(ev(spark, sf))),
    ).select("rule_name", r6("effective_weight", "weight")),
    with_ev(
        "SELECT r.rule_name, round(100 * coalesce(pow(1 - fp / total, 2), 1), 6) AS weight FROM (SELECT DISTINCT unnest([kind, source || '_none']) AS rule_name FROM ev) r "
        "LEFT JOIN (SELECT rule_name, count(*)::DOUBLE AS total, sum(CASE WHEN fp THEN 1 ELSE 0 END)::DOUBLE AS fp FROM fbk GROUP BY rule_name) s USING (rule_name)", FEEDBACK,
    ),
)
add(
    "b2_weighted_scores",
    lambda spark, sf: H.score(
        ev(spark, sf).crossJoin(F.broadcast(B.weight_map(B.stats(T.feedback(ev(spark, sf))), [r.name for r in H.DEFAULT_RULES]))), H.DEFAULT_RULES, F.col("weights")
    ).select("seq", r6("heuristic_score", "score")),
    with_scored(f"SELECT seq, round({' + '.join(f"({points}) * coalesce(w['{rule}'], 1)" for rule, points in RULE_SQL.items())}, 6) AS score FROM hs, weights", FEEDBACK,
        "weights AS (SELECT map(list(rule_name), list(w)) AS w FROM (SELECT rule_name, pow(1 - sum(CASE WHEN fp THEN 1 ELSE 0 END)::DOUBLE / count(*), 2) AS w FROM fbk GROUP BY rule_name))"),
)
add(
    "b3_fp_rate", lambda spark, sf: B.fp_rate(T.feedback(ev(spark, sf))).select("labels", "false_positives", r6("fp_rate", "rate"), F.col("exceeded").cast("int").alias("exceeded")),
    with_ev(
        "SELECT count(*) AS labels, CAST(sum(fp::INT) AS BIGINT) AS false_positives, round(sum(fp::INT) / count(*)::DOUBLE, 6) AS rate, "
        "CASE WHEN count(*) >= 10 AND sum(fp::INT) / count(*)::DOUBLE > 0.3 THEN 1 ELSE 0 END AS exceeded FROM fbk", FEEDBACK,
    ),
)
