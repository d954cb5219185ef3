"""Entity risk state."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostwarden.catalog.base import STATE_SQL, add, r6, with_scored_recursive
from hostwarden.catalog.correlating import scored
from hostwarden.config import Thresholds
from hostwarden.operators import risk_state as E
from hostwarden.sources import sinks as K

TH = Thresholds()
AS_OF = 1704067200000000 + 3_000_000_000


def tracked(spark, sf, payload=()):
    return E.track(scored(spark, sf), score_col="heuristic_score", payload=payload)


# The state machine as a plain loop over each entity's events.
LOOP = f"""
o AS (SELECT entity_id, seq, us, source, remote_addr, heuristic_score AS x, row_number() OVER (PARTITION BY entity_id ORDER BY us, seq) AS rn,
        lead(us) OVER (PARTITION BY entity_id ORDER BY us, seq) AS next_us FROM ge),
fsm AS (
  SELECT entity_id, rn, seq, us, x, source, next_us, x AS score, x >= 90 AS blocked, 0.0::DOUBLE AS before_score, false AS before_blocked, us AS born_us, source AS first_source, 1::BIGINT AS event_count, true AS fresh
  FROM o WHERE rn = 1
  UNION ALL
  SELECT o.entity_id, o.rn, o.seq, o.us, o.x, o.source, o.next_us,
    CASE WHEN f.blocked THEN f.score + o.x ELSE o.x + greatest(0, f.score - 2.5 * (o.us // 30000000 - f.us // 30000000)) END,
    f.blocked OR o.x + greatest(0, f.score - 2.5 * (o.us // 30000000 - f.us // 30000000)) >= 90,
    CASE WHEN f.blocked THEN f.score ELSE greatest(0, f.score - 2.5 * (o.us // 30000000 - f.us // 30000000)) END,
    f.blocked,
    CASE WHEN g.gone THEN o.us ELSE f.born_us END, CASE WHEN g.gone THEN o.source ELSE f.first_source END, CASE WHEN g.gone THEN 1 ELSE f.event_count + 1 END, g.gone
  FROM fsm f JOIN o ON o.entity_id = f.entity_id AND o.rn = f.rn + 1,
  LATERAL (SELECT NOT f.blocked AND (o.us // 30000000 - f.us // 30000000) >= greatest(ceil(f.score / 2.5), 1) AND o.us // 30000000 * 30000000 - f.us > 600000000 AS gone) g
),
st AS (SELECT *, CASE WHEN blocked THEN 4 ELSE {STATE_SQL.format(s='score')} END AS state, CASE WHEN before_blocked THEN 4 ELSE {STATE_SQL.format(s='before_score')} END AS before_state FROM fsm)"""
# One row per decay grid line between an event and the next.
TICKS = f"""
tk AS (SELECT entity_id, seq, us, score, unnest(range(1, least(coalesce(next_us, us + 7200000000) // 30000000 - us // 30000000, 60) + 1)) AS k FROM st WHERE state < 4),
steps AS (SELECT entity_id, seq, (us // 30000000 + k) * 30000000 AS us, {STATE_SQL.format(s='greatest(score - 2.5 * (k - 1), 0)')} AS from_state,
            {STATE_SQL.format(s='greatest(score - 2.5 * k, 0)')} AS to_state, greatest(score - 2.5 * k, 0) AS score FROM tk)"""


def loop(select: str, *ctes: str) -> str:
    return with_scored_recursive(select, LOOP, *ctes)


add(
    "e1_accumulate",
    lambda spark, sf: E.with_incarnation(tracked(spark, sf)).select("entity_id", "seq", "event_count", F.col("born_us").alias("first_seen_us"), "first_source"),
    loop("SELECT entity_id, seq, event_count, born_us AS first_seen_us, first_source FROM st"),
)
add("e2_decayed_score", lambda spark, sf: tracked(spark, sf).select("entity_id", "seq", r6("score", "score")), loop("SELECT entity_id, seq, round(score, 6) AS score FROM st"))
add("e3_state", lambda spark, sf: tracked(spark, sf).select("entity_id", "seq", "state"), loop("SELECT entity_id, seq, state FROM st"))
add(
    "e4_blocked_absorbing", lambda spark, sf: tracked(spark, sf).where("state = 4").select("entity_id", "seq", r6("score", "score")),
    loop("SELECT entity_id, seq, round(score, 6) AS score FROM st WHERE blocked"),
)
add(
    "e5_event_transitions",
    lambda spark, sf: E.event_transitions(tracked(spark, sf)).select("entity_id", "seq", "us", "from_state", "to_state", r6("score", "score")),
    loop("SELECT entity_id, seq, us, before_state AS from_state, state AS to_state, round(score, 6) AS score FROM st WHERE state <> before_state"),
)
add(
    "e6_decay_transitions",
    lambda spark, sf: E.decay_transitions(tracked(spark, sf)).select("entity_id", "seq", "us", "from_state", "to_state", r6("score", "score")),
    loop("SELECT entity_id, seq, us, from_state, to_state, round(score, 6) AS score FROM steps WHERE from_state <> to_state", TICKS),
)
add("e7_fresh_starts", lambda spark, sf: tracked(spark, sf).select("entity_id", "seq", F.col("fresh").cast("int").alias("fresh")), loop("SELECT entity_id, seq, fresh::INT AS fresh FROM st"))
add(
    "e8_merge_details",
    lambda spark, sf: E.merge_details(scored(spark, sf), tracked(spark, sf), ["pid", "name", "exe", "remote_addr", "count", "path", "cpu_pct"]).select(
        "entity_id", "pid", "name", "exe", "remote_addr", F.col("count").alias("n"), "path", "cpu_pct"
    ),
    loop(
        "SELECT entity_id, arg_max(pid, (us, seq)) FILTER (pid IS NOT NULL) AS pid, arg_max(name, (us, seq)) FILTER (name IS NOT NULL) AS name, arg_max(exe, (us, seq)) FILTER (exe IS NOT NULL) AS exe, "
        "arg_max(remote_addr, (us, seq)) FILTER (remote_addr IS NOT NULL) AS remote_addr, arg_max(cnt, (us, seq)) FILTER (cnt IS NOT NULL) AS n, arg_max(path, (us, seq)) FILTER (path IS NOT NULL) AS path, "
        "arg_max(cpu_pct, (us, seq)) FILTER (cpu_pct IS NOT NULL) AS cpu_pct FROM ge JOIN (SELECT entity_id, max(born_us) AS born_us FROM st GROUP BY entity_id) b USING (entity_id) WHERE us >= b.born_us GROUP BY entity_id"
    ),
)
SNAP = f"""
lastrow AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY us DESC, seq DESC) AS back FROM st WHERE us <= {AS_OF}),
snap AS (SELECT entity_id, first_source AS source, born_us AS first_seen_us, us AS last_event_us, event_count,
           CASE WHEN blocked THEN score ELSE greatest(score - 2.5 * ({AS_OF} // 30000000 - us // 30000000), 0) END AS score, blocked
         FROM lastrow WHERE back = 1 AND (blocked OR NOT (({AS_OF} // 30000000 - us // 30000000) >= greatest(ceil(score / 2.5), 1) AND {AS_OF} // 30000000 * 30000000 - us > 600000000))),
snaps AS (SELECT *, CASE WHEN blocked THEN 4 ELSE {STATE_SQL.format(s='score')} END AS state FROM snap)"""


def snapshot(spark, sf):
    return E.snapshot(tracked(spark, sf), AS_OF)


_SNAP_SELECT = "SELECT entity_id, source, round(score, 6) AS score, state, first_seen_us, last_event_us, event_count FROM snaps"


def _snap_cols(df):
    return df.select("entity_id", "source", r6("score", "score"), "state", "first_seen_us", "last_event_us", "event_count")


add("e9_snapshot", lambda spark, sf: _snap_cols(snapshot(spark, sf)), loop(_SNAP_SELECT, SNAP))
add(
    "e10_entity_lookup", lambda spark, sf: _snap_cols(snapshot(spark, sf).where("entity_id = 'file:/etc/shadow'")),
    loop(_SNAP_SELECT + " WHERE entity_id = 'file:/etc/shadow'", SNAP),
)
add(
    "e11_previous_state", lambda spark, sf: tracked(spark, sf).select("entity_id", "seq", F.col("before_state").alias("prev_state"), r6("before_score", "prev_score")),
    loop("SELECT entity_id, seq, before_state AS prev_state, round(before_score, 6) AS prev_score FROM st"),
)
_LABEL = "(['CLEAN','WATCHING','SUSPICIOUS','THREAT','BLOCKED'])[{} + 1]"
add(
    "k5_transition_lines", lambda spark, sf: K.transition_lines(E.transitions(tracked(spark, sf))),
    loop(
        f"SELECT '[' || strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ') || '] [STATE] State change: ' || entity_id || ' [' || {_LABEL.format('from_state')} || ' → ' || {_LABEL.format('to_state')} "
        "|| '] (score: ' || printf('%.1f', score) || ')' AS value FROM (SELECT entity_id, us, before_state AS from_state, state AS to_state, score FROM st WHERE state <> before_state "
        "UNION ALL SELECT entity_id, us, from_state, to_state, score FROM steps WHERE from_state <> to_state)", TICKS,
    ),
)
add(
    "k6_block_list", lambda spark, sf: K.block_list(tracked(spark, sf, ("remote_addr",))),
    loop("SELECT DISTINCT o.remote_addr FROM st JOIN o USING (entity_id, rn) WHERE st.state = 4 AND o.remote_addr <> ''"),
)
