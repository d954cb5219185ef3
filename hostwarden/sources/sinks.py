"""Output tables: alert lines, payload rows, block list and response plan. Delivery is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hostwarden.config import ResourceGuardConfig
from hostwarden.functions import expr as X
from hostwarden.operators import scan
from hostwarden.schema import DETAIL_COLUMNS

RFC3339 = "yyyy-MM-dd'T'HH:mm:ssXXX"
CLOCK = "yyyy-MM-dd HH:mm:ss"


def _bracketed(values: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(" ", values), F.lit("]"))


def alert_line() -> Column:
    """The log line of a scored event."""
    return F.concat(
        F.format_string(
            "[%s] [%s] [%s] %s | entity=%s score=%.1f", F.date_format("ts", RFC3339), "severity_label", "source",
            "message", "entity_id", "score",
        ),
        F.when(F.size("patterns") > 0, F.concat(F.lit(" patterns="), _bracketed(F.col("patterns")))).otherwise(""),
        F.when(F.size("sigma_rules") > 0, F.concat(F.lit(" sigma="), _bracketed(F.col("sigma_rules")))).otherwise(""),
        F.when(F.col("anomaly_score") > 0, F.format_string(" anomaly=%.2f", "anomaly_score")).otherwise(""),
        F.when(F.col("multiplier") > 1, F.format_string(" mult=%.1fx", "multiplier")).otherwise(""),
    )


def alert_lines(scored: DataFrame) -> DataFrame:
    return scored.select(alert_line().alias("value"))


def console_line() -> Column:
    return F.format_string("[%s] [%-8s] %s", F.date_format("ts", CLOCK), "severity_label", "message")


def console_lines(scored: DataFrame) -> DataFrame:
    return scored.select(console_line().alias("value"))


def transition_lines(transitions: DataFrame) -> DataFrame:
    """State-change log lines."""
    return transitions.select(F.format_string(
        "[%s] [STATE] State change: %s [%s → %s] (score: %.1f)",
        F.date_format(F.timestamp_micros("us"), RFC3339), "entity_id", "from_label", "to_label", "score",
    ).alias("value"))


def webhook_payloads(scored: DataFrame, min_severity: int = 2) -> DataFrame:
    """JSON rows for events of at least MEDIUM severity."""
    details = F.struct(*DETAIL_COLUMNS)
    payload = F.to_json(F.struct(
        F.date_format("ts", RFC3339).alias("timestamp"), F.col("severity_label").alias("severity"), "source", "kind", "entity_id",
        "message", "score", details.alias("details"), "patterns", "sigma_rules", "anomaly_score",
        F.coalesce("multiplier", F.lit(0.0)).alias("multiplier"), "threat_intel",
    ))
    return scored.where(F.col("severity") >= min_severity).select("host_id", "seq", payload.alias("payload"))


def notifications(scored: DataFrame, title: str = "Security alert", min_severity: int = 3) -> DataFrame:
    """Title, body and urgency for events of at least HIGH severity."""
    country = X.country_of(F.col("threat_intel"))
    body = F.concat(
        F.col("message"),
        F.when(F.size("patterns") > 0, F.concat(F.lit(" | Patterns: "), X.join_list(F.col("patterns")))).otherwise(""),
        F.when(F.size("sigma_rules") > 0, F.concat(F.lit(" | Sigma: "), X.join_list(F.col("sigma_rules")))).otherwise(""),
        F.when(country != "", F.concat(F.lit(" | Country: "), country)).otherwise(""),
    )
    return scored.where(F.col("severity") >= min_severity).select(
        "host_id", "seq", F.format_string("%s [%s]", F.lit(title), "severity_label").alias("title"), body.alias("body"),
        F.when(F.col("severity") >= 4, "critical").otherwise("normal").alias("urgency"),
    )


def feed(scored: DataFrame) -> DataFrame:
    """The live feed projection as JSON rows; the country only when known. Works on streams."""
    country = X.country_of(F.col("threat_intel"))
    return scored.select("host_id", "seq", F.to_json(F.struct(
        F.date_format("ts", "HH:mm:ss").alias("time"), F.lower("severity_label").alias("severity"),
        F.col("severity_label").alias("label"), "source", "message", "score", F.col("entity_id").alias("entity"),
        "patterns", "sigma_rules", "anomaly_score", F.coalesce("multiplier", F.lit(0.0)).alias("multiplier"),
        F.when(country != "", country).alias("country"),
    )).alias("data"))


def block_list(tracked: DataFrame) -> DataFrame:
    """Distinct addresses of events whose entity is BLOCKED after the event (``tracked`` carries ``remote_addr``)."""
    return tracked.where((F.col("state") == 4) & (F.col("remote_addr") != "")).select("remote_addr").distinct()


def response_plan(events: DataFrame, cfg: ResourceGuardConfig = ResourceGuardConfig()) -> DataFrame:
    """What to do about runaway processes: renice every time, or kill; nothing for ``notify``.

    A kill is in flight for ``kill_in_flight_sec``: until then no other one is planned for its (host, pid), afterwards a pid that is
    used again, or survived, gets its next.
    """
    due = events.where(
        F.col("kind").isin("cpu_abuse", "memory_abuse", "spawn_loop")
        & (F.coalesce("pid", F.lit(0)) > 0) & (F.coalesce("name", F.lit("")) != "")
        & ~X.name_matches(F.col("name"), cfg.exempt_processes)
    )
    if not cfg.enabled or cfg.action not in ("renice", "kill"):
        due = due.where(F.lit(False))
    plan = due.select(
        "host_id", "pid", "seq", "ts", "name", F.col("kind").alias("reason"), F.lit(cfg.action).alias("action"),
        F.lit(cfg.renice_value if cfg.action == "renice" else None).cast("int").alias("nice"),
    )
    if cfg.action != "kill":
        return plan
    timed = plan.withColumn("us", X.micros("ts"))
    begun = scan.spaced(timed, ["host_id", "pid"], cfg.kill_in_flight_sec * 1_000_000, 3600 * 1_000_000)
    rest = ["seq", "ts", "name", "reason", "action", "nice"]
    first = timed.join(begun, ["host_id", "pid", "us"]).groupBy("host_id", "pid", "us").agg(F.min_by(F.struct(*rest), "seq").alias("r"))
    return first.select("host_id", "pid", "r.*")
