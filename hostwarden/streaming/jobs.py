"""Whole streaming jobs: micro-batch scoring, alert sinks, and drift-driven model reload."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from hostwarden.config import AnomalyConfig, Config, ThreatIntelConfig
from hostwarden.operators import correlation, drift, feedback, heuristics, isolation_forest, sigma, threat_intel
from hostwarden.plans.scoring import Intel
from hostwarden.schema import MODEL_NODE_DDL
from hostwarden.session import stage
from hostwarden.sources.sigma_rules import active_rules, shipped_rules
from hostwarden.streaming import operators as S
from hostwarden.streaming.stateful import late, used


def score_stateless(events: DataFrame, rules: list[dict] | None = None, gate: bool = True) -> DataFrame:
    """Heuristics and rules on a stream; identical to the batch functions."""
    scored = heuristics.score(events)
    scored = heuristics.gate(scored) if gate else scored
    return sigma.evaluate(scored, shipped_rules() if rules is None else rules)


def start_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what is available now, into a Parquet folder."""
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )


def start_batches(df: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Idempotent: a repeated micro-batch overwrites its own folder."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def enrich_and_write(load_intel: Callable[[], Intel], path: str, rules: list[dict] | None = None) -> Callable[[DataFrame, int], None]:
    """A micro-batch handler: score, enrich with the intel tables as they are now, and write."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        intel = load_intel()
        scored = threat_intel.enrich(score_stateless(batch, rules), intel.abuse, intel.geo, intel.otx, intel.malware, intel.custom)
        total = F.col("heuristic_score") + F.col("sigma_bonus") + F.col("intel_bonus")
        write_batch(heuristics.with_severity(scored.withColumn("score", total)), path, batch_id)

    return handle


class IntelCache:
    """Answers of all providers per address, one folder a micro-batch; the newest answer of an address counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, now: datetime | None = None) -> DataFrame | None:
        """The newest answer per address, without those that had expired at ``now``; None before the first batch."""
        try:
            rows = self.spark.read.parquet(self.path)
        except AnalysisException:
            return None
        newest = rows.groupBy("ip").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "ip"]), F.struct("cached", "batch_id")).alias("r")).select("ip", "r.*")
        return newest if now is None else newest.where(F.col("cache_expires") > F.lit(now).cast("timestamp"))

    def resolved(self) -> DataFrame:
        """As a ``threat_intel.lookup_table``, for ``attach``."""
        return self.table().drop("cached", "cache_expires", "batch_id")


def fill_intel_cache(cache: IntelCache, load_intel: Callable[[], Intel], cfg: ThreatIntelConfig = ThreatIntelConfig()) -> Callable[[DataFrame, int], None]:
    """A micro-batch handler: look up the batch's addresses that the cache does not hold, or only expired, and add the answers.

    Time is event time: an address is looked up again when it is seen more than the time to live after its last lookup.
    A repeated micro-batch does not see its own first attempt and overwrites it.
    """
    ttl = F.expr(f"interval {cfg.cache_ttl_minutes} minutes")

    def handle(batch: DataFrame, batch_id: int) -> None:
        seen = batch.where(F.coalesce("remote_addr", F.lit("")) != "").groupBy(F.col("remote_addr").alias("ip")).agg(F.min("ts").alias("first"), F.max("ts").alias("cached"))
        held = cache.table()
        if held is not None:
            valid = held.where(F.col("batch_id") < batch_id).select("ip", "cache_expires")
            seen = seen.join(valid, "ip", "left").where(F.col("cache_expires").isNull() | (F.col("cached") >= F.col("cache_expires"))).drop("cache_expires")
        seen = stage(seen.select("ip", "cached"), "addresses")
        intel = load_intel()
        answers = threat_intel.lookup_table(seen.select("ip"), intel.abuse, intel.geo, intel.otx, intel.custom)
        write_batch(answers.join(seen, "ip").withColumn("cache_expires", F.col("cached") + ttl), cache.path, batch_id)

    return handle


#: What travels with an event through the stateful operators of ``score_stream``.
_SCORED = ("entity_id", "source", "kind", "heuristic_score", "intel_bonus", "sigma_rules", "sigma_bonus")
_FULL = ("kind", "severity", "severity_label", "event_score", "multiplier", "related_count", "patterns", "sigma_rules", "intel_bonus", "sigma_bonus")


def score_stream(
    events: DataFrame, cfg: Config = Config(), rules: list[dict] | None = None, resolved: DataFrame | None = None, malware: DataFrame | None = None,
    custom: tuple[str, ...] = (), delay: str = "1 minute",
) -> DataFrame:
    """The pipeline as one streaming query: heuristics, gate, intel, rules, correlation, severity, risk state.

    Two stateful operators in a row, correlation per (host, pid) and risk per (host, entity); the first passes its
    watermark on. One row per event that passes the gate, with its scores and its entity's state before and after (``cause`` none
    or event), one row per state change by decay (``cause`` decay), and late rows with ``late`` set and no ``cause``.
    ``resolved`` holds looked-up answers per address (``IntelCache.resolved``).
    """
    stream = heuristics.gate(heuristics.score(events.withWatermark("ts", delay)))
    if resolved is not None:
        stream = threat_intel.attach(stream, resolved, malware, custom)
    else:
        stream = stream.withColumn("intel_bonus", F.lit(0.0))
    stream = sigma.evaluate(stream, active_rules(events.sparkSession, cfg.sigma_rules_dir) if rules is None else rules)
    found = S.correlate(stream, cfg.correlator, payload=_SCORED, delay=None, event_time=True, keep_late=True, keep_alone=True)
    both = found.withColumn("multiplier", F.when(F.col("pid").isNotNull(), correlation.multiplier(F.col("source_count"), cfg.correlator)))
    total = correlation.effective_score(F.col("heuristic_score")) + F.col("intel_bonus") + F.col("sigma_bonus")
    scored = heuristics.with_severity(both.withColumn("score", total)).withColumn("event_score", F.col("score"))
    return S.track_risk(scored, cfg.thresholds, payload=_FULL, delay=None)


def write_with_late(path: str, late_path: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch handler for an operator's output with ``late``: used rows and late rows to a table each."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            write_batch(used(rows), path, batch_id)
            write_batch(late(rows), late_path, batch_id)
        finally:
            rows.unpersist()

    return handle


class ModelStore:
    """Versioned models under one folder: the nodes in ``models/version=N``, and one commit row a version that names them.

    A commit holds the baseline of the version's training rows and the micro-batch that made it, and is written last, so a
    version is either whole or not there. A repeated micro-batch sees only commits of earlier ones, decides the same, and
    overwrites its own. ``rows`` holds the bounded buffer of the newest feature rows as each micro-batch left it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, folder: str, ddl: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(ddl).parquet(f"{self.path}/{folder}")
        except AnalysisException:
            return None

    def commits(self, before: int | None = None) -> list[Row]:
        """Commits by version, on request only those of micro-batches before a given one."""
        table = self._table("commits", _COMMIT_DDL + ", batch_id bigint")
        if table is None:
            return []
        return sorted((table if before is None else table.where(F.col("batch_id") < before)).collect(), key=lambda r: r["version"])

    def versions(self) -> list[int]:
        return [c["version"] for c in self.commits()]

    def publish(self, model: DataFrame, base: DataFrame | None = None, batch_id: int | None = None, reason: str = "") -> int:
        """Store a model with the baseline of its training rows (``drift.baseline``); without a micro-batch it counts as a batch after all others."""
        known = self.commits(batch_id)
        version = known[-1]["version"] + 1 if known else 0
        model.write.mode("overwrite").parquet(f"{self.path}/models/version={version}")
        row = (0, 0.0, 0.0) if base is None else tuple(base.select("n", "base_mean", "base_std").first())
        at = batch_id if batch_id is not None else (known[-1]["batch_id"] + 1 if known else 0)
        self.spark.createDataFrame([(version, *row, reason)], _COMMIT_DDL).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch_id={at}")
        return version

    def model(self, version: int) -> DataFrame:
        return self.spark.read.schema(MODEL_NODE_DDL).parquet(f"{self.path}/models/version={version}")

    def current(self, before: int | None = None) -> DataFrame | None:
        known = self.commits(before)
        return self.model(known[-1]["version"]) if known else None

    def buffered(self, rows: DataFrame, batch_id: int, most: int | None) -> DataFrame:
        """The buffer after this micro-batch: the newest ``most`` of the rows before it and its own (all if None)."""
        held = self._table("rows", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", batch_id bigint")
        if held is not None:
            last = held.where(F.col("batch_id") < batch_id).agg(F.max("batch_id")).first()[0]
            if last is not None:
                rows = rows.unionByName(held.where(F.col("batch_id") == last).drop("batch_id"))
        kept = rows if most is None else isolation_forest.retraining_rows(rows, most)
        kept.write.mode("overwrite").parquet(f"{self.path}/rows/batch_id={batch_id}")
        return self.spark.read.schema(kept.schema).parquet(f"{self.path}/rows/batch_id={batch_id}")


_COMMIT_DDL = "version bigint, n bigint, base_mean double, base_std double, reason string"


def drift_handler(
    store: ModelStore, score_path: str, cfg: AnomalyConfig = AnomalyConfig(), load_feedback: Callable[[], DataFrame] | None = None,
) -> Callable[[DataFrame, int], None]:
    """A micro-batch handler over feature rows: train, score, test for drift, retrain; every batch is a check.

    Until there are ``min_training_rows``, rows are kept and score 0 (version -1). The first model is trained on all rows so
    far. Later batches are scored with the current version; the test compares the last ``drift_window_size`` scores of that
    version, so the window is empty after a retrain, with the scores of the version's own training rows. A retrain uses the last
    ``max_buffer`` rows. Labels whose false-positive rate is exceeded cause a retrain too, then not again for three checks.
    """

    def commit(rows: DataFrame, batch_id: int, reason: str) -> bool:
        fitted = isolation_forest.fit(rows, cfg)
        if fitted is None:
            return False
        fitted = stage(fitted, "model")
        store.publish(fitted, drift.baseline(isolation_forest.score(rows, fitted, cfg)), batch_id, reason)
        return True

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        commits = store.commits(before=batch_id)
        buffer = store.buffered(batch, batch_id, cfg.max_buffer if commits else None)
        if not commits:
            write_batch(batch.withColumns({"anomaly_score": F.lit(0.0), "version": F.lit(-1).cast("bigint")}), score_path, batch_id)
            commit(buffer, batch_id, "first training")
            return
        now = commits[-1]
        scored = isolation_forest.score(batch, store.model(now["version"]), cfg)
        write_batch(scored.withColumn("version", F.lit(now["version"]).cast("bigint")), score_path, batch_id)
        since = spark.read.schema("host_id string, seq bigint, ts timestamp, anomaly_score double, version bigint, batch_id bigint").parquet(score_path).where(
            (F.col("batch_id") > now["batch_id"]) & (F.col("batch_id") <= batch_id)
        )
        base = spark.createDataFrame([(now["n"], now["base_mean"], now["base_std"])], "n bigint, base_mean double, base_std double")
        found = drift.test(since, base, cfg).first()
        reasons = [f"score mean shifted {found['drift_sigma']:.1f}σ"] if found["drifted"] else []
        if load_feedback is not None:
            labels = feedback.fp_rate(load_feedback(), cfg.min_feedback, cfg.fp_rate_threshold).first()
            last = max((c["batch_id"] for c in commits if "FP rate" in c["reason"]), default=None)
            if labels["exceeded"] and (last is None or batch_id - last > 3):
                reasons.append(f"FP rate {labels['fp_rate'] * 100:.0f}%")
        if reasons:
            commit(buffer, batch_id, " + ".join(reasons))

    return handle
