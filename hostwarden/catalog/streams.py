"""Streaming operators, run over what is available and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostwarden.catalog.base import ORACLE, add, ev, query, r6, us, with_ev, with_scored, with_scored_recursive
from hostwarden.catalog.correlating import BEACON_SQL, CORR, FEEDBACK, scored
from hostwarden.catalog.detection import RULES, SIGMA_BONUS_SQL
from hostwarden.catalog.enrichment import INTEL_BONUS_SQL, INTEL_JOIN, TABLES
from hostwarden.catalog.flagship import intel_tables
from hostwarden.catalog.monitoring import FS, NET, PS, RS, _SPAWN, cs, fs, ps, rs, sql
from hostwarden.catalog.learning import FEAT, _ALL, feature_table, forest_sql
from hostwarden.catalog.reporting import R0
from hostwarden.catalog.state import AS_OF, LOOP, TICKS, _snap_cols as snapshot_columns, loop
from hostwarden.operators import heuristics as H, process_monitor as P, resource_monitor as RM
from hostwarden.plans import live as L, reports as R
from hostwarden.schema import FEATURES
from hostwarden.session import configure, shared_dir, stage
from hostwarden.sources import sample_tables as T
from hostwarden.streaming import jobs, operators as S
from hostwarden.streaming.stateful import used


#: Micro-batches of every stream below.
SLICES = 4


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def sliced_stream(table: DataFrame, us: Column, slices: int = SLICES) -> DataFrame:
    """A table as a file stream of ``slices`` micro-batches, cut by time: files are read in the order of their writing."""
    spark = table.sparkSession
    folder, files = _folder(spark, "stream-in"), spark.sparkContext.defaultParallelism
    low, high = table.agg(F.min(us), F.max(us)).first()
    at = F.least(F.floor((us - low) * slices / max(high - low, 1)), F.lit(slices - 1)) if low is not None else F.lit(0)
    for k in range(slices):
        table.where(at == k).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(folder)


def telemetry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return T.shape_telemetry(sliced_stream(T.raw_events(spark, sf_dir), F.unix_micros(F.col("ts").cast("timestamp"))))


def table_stream(table: DataFrame, by: str = "scan_ts") -> DataFrame:
    """A stored table as a stream."""
    return sliced_stream(table, F.col(by) if by == "us" else F.unix_micros(by))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input and return what it wrote."""
    spark = stream.sparkSession
    out = _folder(spark, "stream-out")
    if mode == "append":
        job = jobs.start_parquet(stream, out, _folder(spark, "stream-state"))
    else:
        job = jobs.start_batches(stream, lambda df, n: df.write.mode("overwrite").parquet(out), _folder(spark, "stream-state"), mode)
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


add(
    "t1_stateless_scores",
    lambda spark, sf: drained(jobs.score_stateless(telemetry_stream(spark, sf)).select("seq", "heuristic_score", "sigma_bonus")),
    with_scored(f"SELECT seq, heuristic_score, CAST({SIGMA_BONUS_SQL} AS DOUBLE) AS sigma_bonus FROM ge"),
)


@query("t1_enriched_batches", with_scored(
    f"SELECT e.seq, CAST({INTEL_BONUS_SQL} AS DOUBLE) AS intel_bonus FROM ge e {INTEL_JOIN}", TABLES,
))
def _enriched(spark, sf):
    out = _folder(spark, "scored-batches")
    events = ev(spark, sf)
    handler = jobs.enrich_and_write(lambda: intel_tables(events), out)
    jobs.start_batches(telemetry_stream(spark, sf), handler, _folder(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).select("seq", "intel_bonus")


_PIPED: dict[tuple[str, str], DataFrame] = {}


def piped_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the whole pipeline as one stream writes, run once per session; the intel cache is filled by a stream before it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PIPED:
        intel = intel_tables(ev(spark, sf_dir))
        cache = jobs.IntelCache(spark, _folder(spark, "intel-cache"))
        jobs.start_batches(telemetry_stream(spark, sf_dir), jobs.fill_intel_cache(cache, lambda: intel), _folder(spark, "stream-state")).awaitTermination()
        scored = jobs.score_stream(telemetry_stream(spark, sf_dir), resolved=stage(cache.resolved(), "resolved"), malware=intel.malware)
        _PIPED[key] = drained(scored)
    return _PIPED[key]


add(
    "t1_full_pipeline",
    lambda spark, sf: used(piped_stream(spark, sf)).where("cause <> 'decay'").select(
        "seq", "multiplier", "related_count", F.concat_ws("|", "patterns").alias("patterns"), F.concat_ws("|", "sigma_rules").alias("sigma_rules"),
        "severity", "severity_label", r6("intel_bonus", "intel_bonus"), r6("sigma_bonus", "sigma_bonus"), r6("event_score", "score"),
    ),
    ORACLE["r0_score_events"],
)
# The state machine over the full scores.
FULL_LOOP = LOOP.replace("heuristic_score AS x", "score AS x").replace("FROM ge)", "FROM r0)")
add(
    "t1_full_transitions",
    lambda spark, sf: used(piped_stream(spark, sf)).where("cause <> 'none'").select("entity_id", "seq", "us", "from_state", "to_state", "cause", r6("score", "score")),
    with_scored_recursive(
        "SELECT entity_id, seq, us, before_state AS from_state, state AS to_state, 'event' AS cause, round(score, 6) AS score FROM st WHERE state <> before_state "
        "UNION ALL SELECT s.entity_id, s.seq, s.us, s.from_state, s.to_state, 'decay', round(s.score, 6) FROM steps s JOIN st USING (entity_id, seq) WHERE s.from_state <> s.to_state "
        "AND (st.next_us IS NOT NULL OR s.us // 30000000 <= ((SELECT max(us) FROM ev) // 1000 * 1000 - 60000000) // 30000000)", CORR, TABLES, R0, FULL_LOOP, TICKS,
    ),
)


@query("k8_intel_cache_job", with_ev(
    "SELECT ip, CAST(a.ip IS NOT NULL AS INTEGER) AS has_abuse, coalesce(g.country_code, '') AS country, lookups FROM (SELECT remote_addr AS ip, 1::BIGINT AS lookups FROM ev WHERE remote_addr <> '' GROUP BY remote_addr) s "
    "LEFT JOIN (SELECT ip FROM abuse) a USING (ip) LEFT JOIN (SELECT ip, country_code FROM gl) g USING (ip)", TABLES,
))
def _intel_cache(spark, sf):
    """Every address is looked up once: later batches find it in the cache."""
    intel = intel_tables(ev(spark, sf))
    cache = jobs.IntelCache(spark, _folder(spark, "intel-cache"))
    jobs.start_batches(telemetry_stream(spark, sf), jobs.fill_intel_cache(cache, lambda: intel), _folder(spark, "stream-state")).awaitTermination()
    counts = spark.read.parquet(cache.path).groupBy("ip").agg(F.count(F.lit(1)).alias("lookups"))
    answers = cache.table().select("ip", F.col("abuseipdb").isNotNull().cast("int").alias("has_abuse"), F.coalesce("geoip.country_code", F.lit("")).alias("country"))
    return answers.join(counts, "ip")


_STATES: dict[tuple[str, str], str] = {}


def risk_checkpoint(spark: SparkSession, sf_dir: str) -> str:
    """The checkpoint of a risk stream over the events up to ``AS_OF``, run once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STATES:
        _STATES[key] = _folder(spark, "risk-state")
        until = H.gate(H.score(telemetry_stream(spark, sf_dir).where(F.unix_micros("ts") <= AS_OF)))
        jobs.start_parquet(S.track_risk(until, score_col="heuristic_score"), _folder(spark, "stream-out"), _STATES[key]).awaitTermination()
    return _STATES[key]


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.entities(spark, risk_checkpoint(spark, sf_dir), AS_OF)


add("r2_live_entities", lambda spark, sf: snapshot_columns(live(spark, sf)), ORACLE["e9_snapshot"])
add("r3_live_threat_level", lambda spark, sf: R.threat_level(live(spark, sf)), ORACLE["r3_threat_level"])
add("r4_live_active_threats", lambda spark, sf: R.active_threats(live(spark, sf)), ORACLE["r4_active_threats"])
add(
    "r5_live_status",
    lambda spark, sf: R.status(scored(spark, sf), live(spark, sf), ps(spark, sf), len(RULES), started="2024-01-01 00:00:00", now="2024-01-01 01:02:03").select(
        "uptime_seconds", "process_count", "files_watched", "total_events", "active_threats", "threat_level", "sigma_rules", F.col("learning").cast("int").alias("learning")
    ),
    ORACLE["r5_status"],
)
add(
    "t2_new_processes", lambda spark, sf: drained(S.appeared(table_stream(ps(spark, sf)), ["pid"])).select("seq", "us"),
    sql("SELECT seq, scan_us AS us FROM pnew", PS),
)
add(
    "t2_modified_files", lambda spark, sf: drained(S.modified_files(table_stream(fs(spark, sf)))).select("path", "us", "prev_hash", "new_hash", "prev_size", "new_size"),
    sql("SELECT path, scan_us AS us, prev_hash, hash AS new_hash, prev_size, size AS new_size FROM fmod", FS),
)
add(
    "t3_spawn_counts",
    lambda spark, sf: drained(S.sliding_count(
        table_stream(P.appeared(ps(spark, sf), ["pid"]).where("ppid > 0").select("host_id", "ppid", us("scan_ts"), "seq"), "us"), ["host_id", "ppid"], 60
    )).select("ppid", "seq", F.col("n").alias("spawn_count")),
    sql("SELECT ppid, seq, spawn_count FROM sp", PS, _SPAWN),
)
add(
    "t4_network_verdicts", lambda spark, sf: drained(S.network_verdicts(table_stream(cs(spark, sf)))).select("seq", "us", "pid", "kind"),
    sql("SELECT seq, scan_us AS us, pid, kind FROM nev", NET),
)
add(
    "t5_correlation",
    lambda spark, sf: drained(S.correlate(H.gate(H.score(telemetry_stream(spark, sf))))).select(
        "seq", "source_count", "related_count", F.concat_ws("|", "patterns").alias("patterns"), "pattern_bonus"
    ),
    with_scored("SELECT seq, source_count, related_count, patterns, CAST(pattern_bonus AS DOUBLE) AS pattern_bonus FROM corr", CORR),
)


add(
    "t3_features",
    lambda spark, sf: drained(S.features(telemetry_stream(spark, sf))).select("seq", *[r6(F.col(c) + 1e-9, c) for c in FEATURES]),
    with_ev(f"SELECT seq, {_ALL} FROM feat", FEAT),
)


def _busy_stream(spark, sf):
    from hostwarden.catalog.correlating import busy

    return table_stream(busy(spark, sf), "ts")


@query("t6_beacons", BEACON_SQL)
def _beacons(spark, sf):
    out = drained(S.correlate(_busy_stream(spark, sf)))
    return out.select("seq", "pid", F.array_contains("patterns", "beaconing").cast("int").alias("hit"), F.array_contains("patterns", "ssh_brute_force").cast("int").alias("ssh"))


add(
    "t7_event_transitions",
    lambda spark, sf: drained(S.risk_transitions(H.gate(H.score(telemetry_stream(spark, sf))), score_col="heuristic_score")).where("cause = 'event'").select(
        "entity_id", "seq", "us", "from_state", "to_state", r6("score", "score")
    ),
    loop("SELECT entity_id, seq, us, before_state AS from_state, state AS to_state, round(score, 6) AS score FROM st WHERE state <> before_state"),
)
add(
    "t7_decay_transitions",
    lambda spark, sf: drained(S.risk_transitions(H.gate(H.score(telemetry_stream(spark, sf))), score_col="heuristic_score")).where("cause = 'decay'").select(
        "entity_id", "seq", "us", "from_state", "to_state", r6("score", "score")
    ),
    # Entities idle at the end decay up to the final watermark: one minute before the newest event, in whole milliseconds.
    loop(
        "SELECT s.entity_id, s.seq, s.us, s.from_state, s.to_state, round(s.score, 6) AS score FROM steps s JOIN st USING (entity_id, seq) WHERE s.from_state <> s.to_state "
        "AND (st.next_us IS NOT NULL OR s.us // 30000000 <= ((SELECT max(us) FROM ge) // 1000 * 1000 - 60000000) // 30000000)", TICKS,
    ),
)
add(
    "t8_cooldown",
    lambda spark, sf: drained(S.cooldown(table_stream(RM.candidates(rs(spark, sf)).select("host_id", "pid", "kind", "life", us("scan_ts"), "seq"), "us"))).select("seq", "us", "pid", "kind"),
    sql("SELECT seq, scan_us AS us, pid, kind FROM rev", RS),
)
add(
    "t9_cpu_baseline", lambda spark, sf: drained(S.cpu_baseline(table_stream(rs(spark, sf)))).select("seq", r6("base_mean", "mean"), r6("base_std", "std")),
    sql("SELECT seq, round(mean, 6) AS mean, round(std, 6) AS std FROM rb", RS),
)


_SHIFTED = ", ".join(f"{c} * CASE WHEN batch >= 2 THEN 40 ELSE 1 END + CASE WHEN batch >= 2 THEN 500 ELSE 0 END AS {c}" for c in FEATURES)
CYCLE = f"""
cut AS (SELECT *, least(floor((us - min(us) OVER ()) * 4 / greatest(max(us) OVER () - min(us) OVER (), 1)), 3) AS batch FROM feat),
fed AS (SELECT seq, us, batch, {_SHIFTED} FROM cut),
train0 AS (SELECT * FROM fed WHERE batch = 0), rest0 AS (SELECT * FROM fed WHERE batch <= 2),
train1 AS (SELECT * FROM fed WHERE batch <= 2 ORDER BY us DESC, seq DESC LIMIT 1000), rest1 AS (SELECT * FROM train1 UNION SELECT * FROM fed WHERE batch = 3),
{forest_sql("train0", "v0", "rest0")}, {forest_sql("train1", "v1", "rest1")}"""


def cycle(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Feature rows in four micro-batches, the last two of which behave otherwise: scores and commits.

    The first batch trains, the second is as before, the third drifts and makes the second version, the fourth is as the third. The
    SQL follows that course, which holds from 10,000 events on; 1,000 events scatter so much that there is one more retrain.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CYCLES:
        store, scores = jobs.ModelStore(spark, _folder(spark, "models")), _folder(spark, "scores")
        table = feature_table(spark, sf_dir)
        at = F.unix_micros("ts")
        low, high = table.agg(F.min(at), F.max(at)).first()
        later = (at - low) * 4 >= 2 * max(high - low, 1)
        shifted = table.withColumns({c: F.when(later, F.col(c) * 40 + 500).otherwise(F.col(c)) for c in FEATURES})
        jobs.start_batches(table_stream(shifted, "ts"), jobs.drift_handler(store, scores), _folder(spark, "stream-state")).awaitTermination()
        _CYCLES[key] = (spark.read.parquet(scores), spark.createDataFrame(store.commits()))
    return _CYCLES[key]


_CYCLES: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}
add(
    "t10_drift_and_reload",
    lambda spark, sf: cycle(spark, sf)[0].groupBy("version").agg(F.count(F.lit(1)).alias("rows"), r6(F.avg("anomaly_score"), "mean_score"), r6(F.max("anomaly_score"), "max_score")),
    with_ev(
        "SELECT version, count(*) AS rows, round(avg(s), 6) AS mean_score, round(max(s), 6) AS max_score FROM ("
        "SELECT -1 AS version, 0.0::DOUBLE AS s FROM train0 UNION ALL SELECT 0, anomaly_score FROM v0anomaly JOIN fed USING (seq) WHERE batch BETWEEN 1 AND 2 "
        "UNION ALL SELECT 1, anomaly_score FROM v1anomaly JOIN fed USING (seq) WHERE batch = 3) GROUP BY version", FEAT, CYCLE,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
add(
    "t10_commits",
    lambda spark, sf: cycle(spark, sf)[1].select("version", "batch_id", "n", r6("base_mean", "mean"), r6("base_std", "std"), "reason"),
    with_ev(
        "SELECT 0 AS version, 0 AS batch_id, count(*) AS n, round(avg(anomaly_score), 6) AS mean, round(stddev_pop(anomaly_score), 6) AS std, 'first training' AS reason FROM v0anomaly JOIN train0 USING (seq) "
        "UNION ALL SELECT 1, 2, count(*), round(avg(anomaly_score), 6), round(stddev_pop(anomaly_score), 6), (SELECT 'score mean shifted ' || printf('%.1f', abs(r - m) / s) || 'σ' FROM "
        "(SELECT avg(anomaly_score) AS r FROM (SELECT anomaly_score FROM v0anomaly JOIN rest0 USING (seq) ORDER BY us DESC, seq DESC LIMIT 200)), "
        "(SELECT avg(anomaly_score) AS m, stddev_pop(anomaly_score) AS s FROM v0anomaly JOIN train0 USING (seq))) FROM v1anomaly JOIN train1 USING (seq)", FEAT, CYCLE,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)


add(
    "t11_watermarked_counts",
    lambda spark, sf: drained(S.windowed_kinds(telemetry_stream(spark, sf))).select("kind", us("window_start"), "n"),
    with_ev(
        "SELECT kind, us // 300000000 * 300000000 AS us, count(*) AS n FROM ev GROUP BY kind, us // 300000000 HAVING (us // 300000000 + 1) * 300000000 <= (SELECT max(us) FROM ev) // 1000 * 1000 - 60000000"
    ),
)
#: Every 50th event of the second and third batch comes with the last one instead, ten minutes or more behind.
def late_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = T.raw_events(spark, sf_dir)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = raw.agg(F.min(at), F.max(at)).first()
    share = (at - low) / max(high - low, 1)
    delayed = F.when((F.col("event_id") % 50 == 0) & share.between(0.25, 0.6), F.lit(0.99)).otherwise(share)
    slices = [delayed < 0.25, (delayed >= 0.25) & (delayed < 0.5), (delayed >= 0.5) & (delayed < 0.75), delayed >= 0.75]
    folder, files = _folder(spark, "stream-in"), spark.sparkContext.defaultParallelism
    for part in slices:
        raw.where(part).repartition(files).write.mode("append").parquet(folder)
    return T.shape_telemetry(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", files).parquet(folder))


@query("t11_late_rows", with_ev(
    "SELECT seq, us, CAST(us < mark AS INTEGER) AS late FROM dealt LEFT JOIN marks USING (batch)",
    "sh AS (SELECT seq, us, (raw_us - min(raw_us) OVER ()) / (max(raw_us) OVER () - min(raw_us) OVER ())::DOUBLE AS share FROM ev)",
    "dealt AS (SELECT seq, us, least(floor(CASE WHEN seq % 50 = 0 AND share BETWEEN 0.25 AND 0.6 THEN 0.99 ELSE share END * 4), 3) AS batch FROM sh)",
    # The watermark of a batch: a minute before the newest event of all batches before it, in whole milliseconds.
    "tops AS (SELECT batch, max(us) AS top FROM dealt GROUP BY batch)",
    "marks AS (SELECT b.batch, coalesce((SELECT max(t.top) FROM tops t WHERE t.batch < b.batch) // 1000 * 1000 - 60000000, 0) AS mark FROM tops b)",
))
def _late(spark, sf):
    """Every event is either used or in the late table, by the watermark of its micro-batch."""
    out, behind = _folder(spark, "used"), _folder(spark, "late")
    rows = S.gated(late_stream(spark, sf), [])
    jobs.start_batches(rows, jobs.write_with_late(out, behind), _folder(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).select("seq", "us", F.lit(0).alias("late")).unionByName(spark.read.parquet(behind).select("seq", "us", F.lit(1).alias("late")))


add(
    "t12_feedback_totals", lambda spark, sf: drained(S.feedback_totals(T.feedback(telemetry_stream(spark, sf))), "complete"),
    with_ev(
        "SELECT rule_name, count(*) AS total, CAST(sum(CASE WHEN fp THEN 0 ELSE 1 END) AS BIGINT) AS true_positives, CAST(sum(CASE WHEN fp THEN 1 ELSE 0 END) AS BIGINT) AS false_positives FROM fbk GROUP BY rule_name",
        FEEDBACK,
    ),
)
