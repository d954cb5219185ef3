"""Per-event heuristic points, severity and the zero-score gate.

Each rule is a ``Column`` expression; the whole rule set evaluates in one projection.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from hostwarden.functions import expr as X

# fixed values: what the rules look for
SUSPICIOUS_PATHS = ("/tmp/", "/var/tmp/", "/dev/shm/", "/.cache/", "/Downloads/")
TEMP_PATHS = ("/tmp/", "/var/tmp/", "/dev/shm/")
SYSTEM_HOMES = {"sshd": "/usr/sbin/", "systemd": "/usr/lib/systemd/", "cron": "/usr/sbin/", "init": "/sbin/"}
PRIVILEGE_TOOLS = ("su", "sudo", "pkexec", "runuser", "newgrp")
INTERPRETERS = ("bash", "sh", "python", "python3", "perl", "ruby", "node")
CRITICAL_FILES = ("/etc/shadow", "/etc/passwd", "/etc/sudoers")


@dataclass(frozen=True)
class HeuristicRule:
    """``points`` builds a Column of points; null counts as 0. An empty source applies to all events."""

    name: str
    source: str
    points: Callable[[], Column]

    def column(self, weight: Column | None = None) -> Column:
        value = F.coalesce(self.points().cast("double"), F.lit(0.0))
        if weight is not None:
            value = value * weight
        if not self.source:
            return value
        return F.when(F.col("source") == self.source, value).otherwise(0.0)


def _on_kind(kind: str, value: Column | int) -> Column:
    return F.when(F.col("kind") == kind, value if isinstance(value, Column) else F.lit(value))


def _mimicry() -> Column:
    name, exe = F.col("name"), F.col("exe")
    wrong = [(name == n) & ~exe.startswith(home) for n, home in SYSTEM_HOMES.items()]
    return F.when((exe != "") & X.any_of(wrong), 50)


def _privilege() -> Column:
    by_name = F.coalesce(F.col("name").isin(*PRIVILEGE_TOOLS), F.lit(False))
    by_exe = [F.coalesce(F.col("exe").endswith(f"/{t}"), F.lit(False)) for t in PRIVILEGE_TOOLS]
    return F.when(by_name | X.any_of(by_exe), 20)


DEFAULT_RULES: tuple[HeuristicRule, ...] = (
    HeuristicRule("suspicious_path", "process", lambda: F.when(X.contains_any(F.col("exe"), SUSPICIOUS_PATHS), 30)),
    HeuristicRule("name_mimicry", "process", _mimicry),
    HeuristicRule("unusual_hour", "process", lambda: F.when(F.hour("ts").between(2, 5), 10)),
    HeuristicRule("privilege_escalation", "process", _privilege),
    HeuristicRule(
        "scripting_from_temp", "process",
        lambda: F.when(F.col("name").isin(*INTERPRETERS) & X.contains_any(F.col("exe"), TEMP_PATHS), 35),
    ),
    HeuristicRule("high_entropy_name", "process", lambda: F.when(X.is_high_entropy_name(F.col("name")), 20)),
    HeuristicRule("suspicious_port", "network", lambda: _on_kind("suspicious_port", 25)),
    HeuristicRule(
        "high_connection_rate", "network",
        lambda: _on_kind("high_conn_rate", F.when(F.col("count") > 50, 40).when(F.col("count") > 20, 20)),
    ),
    HeuristicRule("outbound_unusual", "network", lambda: _on_kind("new_outbound", 5)),
    HeuristicRule(
        "port_scan", "network",
        lambda: _on_kind("port_scan", F.when(F.col("unique_ports") > 50, 70).when(F.col("unique_ports") > 20, 45)),
    ),
    HeuristicRule(
        "critical_file_modified", "filesystem",
        lambda: _on_kind("file_modified", F.when(F.col("path").isin(*CRITICAL_FILES), 60).otherwise(30)),
    ),
    HeuristicRule(
        "rapid_modifications", "filesystem", lambda: _on_kind("rapid_changes", F.when(F.col("count") > 10, 70))
    ),
    HeuristicRule(
        "cpu_abuse", "resource", lambda: _on_kind("cpu_abuse", F.when(F.col("cpu_pct") >= 95, 50).otherwise(40))
    ),
    HeuristicRule("memory_abuse", "resource", lambda: _on_kind("memory_abuse", 30)),
    HeuristicRule(
        "spawn_loop", "process", lambda: _on_kind("spawn_loop", F.when(F.col("child_count") > 20, 60).otherwise(50))
    ),
)


def register_rule(
    rules: Sequence[HeuristicRule], name: str, source: str, points: Callable[[], Column]
) -> tuple[HeuristicRule, ...]:
    """A rule set with one more user rule."""
    return (*rules, HeuristicRule(name, source, points))


def score_column(rules: Sequence[HeuristicRule] = DEFAULT_RULES, weights: Column | None = None) -> Column:
    """Sum of all rule points. ``weights`` is an optional map<rule name, factor>."""
    parts = []
    for rule in rules:
        factor = None
        if weights is not None:
            factor = F.coalesce(F.try_element_at(weights, F.lit(rule.name)), F.lit(1.0))
        parts.append(rule.column(factor))
    return reduce(add, parts, F.lit(0.0))


def score(
    events: DataFrame, rules: Sequence[HeuristicRule] = DEFAULT_RULES, weights: Column | None = None
) -> DataFrame:
    """Add ``heuristic_score``."""
    return events.withColumn("heuristic_score", score_column(rules, weights))


def explain_hits(events: DataFrame, rules: Sequence[HeuristicRule] = DEFAULT_RULES) -> DataFrame:
    """Add ``rule_hits``: array<struct<rule, points>> of the rules that gave points."""
    hits = [
        F.when(r.column() > 0, F.struct(F.lit(r.name).alias("rule"), r.column().alias("points"))) for r in rules
    ]
    return events.withColumn("rule_hits", F.array_compact(F.array(*hits)))


def gate(scored: DataFrame) -> DataFrame:
    """Drop events without heuristic points."""
    return scored.where(F.col("heuristic_score") > 0)


def with_severity(df: DataFrame, score_col: str = "score") -> DataFrame:
    ranked = df.withColumn("severity", X.severity_rank(F.col(score_col)))
    return ranked.withColumn("severity_label", X.severity_label(F.col("severity")))
