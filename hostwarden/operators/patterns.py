"""Attack patterns over the process, network, file and resource nodes one pid touched recently.

A pattern names the kinds of node it looks for and tests how many of each are live, so any
number of patterns is evaluated from one set of running counters.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from hostwarden.functions import expr as X
from hostwarden.operators.heuristics import CRITICAL_FILES, SUSPICIOUS_PATHS

# fixed values: what the shipped patterns look for
C2_PORTS = (4444, 5555, 6666, 8888, 9999, 1337)
PERSISTENCE_FILES = ("/etc/crontab", "/etc/ssh/sshd_config", "/etc/sudoers")

BEACON = "beacon"  # counter kept by the correlation operator: live addresses that are beaconing


@dataclass(frozen=True)
class Pattern:
    """``nodes`` maps a counter name to a node predicate; ``test`` gets the live counts by name."""

    name: str
    bonus: float
    nodes: Mapping[str, Callable[[], Column]]
    test: Callable[[Mapping[str, Column]], Column]


def _of(source: str, predicate: Callable[[], Column] | None = None) -> Callable[[], Column]:
    def build() -> Column:
        base = F.col("source") == source
        return base if predicate is None else base & F.coalesce(predicate(), F.lit(False))

    return build


PROCESS, NETWORK, FILES = _of("process"), _of("network"), _of("filesystem")


def _all(*names: str) -> Callable[[Mapping[str, Column]], Column]:
    def test(live: Mapping[str, Column]) -> Column:
        out = live[names[0]] > 0
        for n in names[1:]:
            out = out & (live[n] > 0)
        return out

    return test


DEFAULT_PATTERNS: tuple[Pattern, ...] = (
    Pattern(
        "reverse_shell", 40.0,
        {
            "process_in_temp": _of("process", lambda: X.contains_any(F.col("exe"), SUSPICIOUS_PATHS)),
            "c2_connection": _of("network", lambda: F.col("remote_port").isin(*C2_PORTS)),
        },
        _all("process_in_temp", "c2_connection"),
    ),
    Pattern(
        "data_exfiltration", 50.0,
        {
            "process": PROCESS,
            "busy_network": _of("network", lambda: F.col("count") > 20),
            "sensitive_file": _of("filesystem", lambda: F.col("path").isin(*CRITICAL_FILES)),
        },
        _all("process", "busy_network", "sensitive_file"),
    ),
    Pattern(
        "persistence", 35.0,
        {"process": PROCESS, "startup_file": _of("filesystem", lambda: F.col("path").isin(*PERSISTENCE_FILES))},
        _all("process", "startup_file"),
    ),
    Pattern(
        "lateral_movement", 45.0,
        {
            "process": PROCESS,
            "internal_ssh": _of(
                "network", lambda: (F.col("remote_port") == 22) & X.is_private_ip(F.col("remote_addr"))
            ),
        },
        _all("process", "internal_ssh"),
    ),
    Pattern(
        "crypto_miner", 40.0,
        {"random_name": _of("process", lambda: X.is_high_entropy_name(F.col("name"))), "network": NETWORK},
        _all("random_name", "network"),
    ),
    Pattern("beaconing", 55.0, {}, lambda live: live[BEACON] > 0),
    Pattern(
        "runaway_fork", 45.0,
        {
            "spawning": _of("process", lambda: F.col("child_count").isNotNull()),
            "cpu_heavy": _of("resource", lambda: F.col("cpu_pct").isNotNull()),
        },
        _all("spawning", "cpu_heavy"),
    ),
    Pattern(
        "ssh_brute_force", 55.0,
        {"ssh_connection": _of("network", lambda: F.col("remote_port") == 22)},
        lambda live: live["ssh_connection"] >= 5,
    ),
)


def register_pattern(
    patterns: Sequence[Pattern], name: str, bonus: float,
    nodes: Mapping[str, Callable[[], Column]], test: Callable[[Mapping[str, Column]], Column],
) -> tuple[Pattern, ...]:
    """A pattern set with one more user pattern."""
    return (*patterns, Pattern(name, bonus, nodes, test))


def node_flags(patterns: Sequence[Pattern]) -> dict[str, Column]:
    """Counter name to node predicate, over all patterns. Equal names must mean equal predicates."""
    flags: dict[str, Column] = {}
    for p in patterns:
        for name, build in p.nodes.items():
            if name not in flags:
                flags[name] = F.coalesce(build(), F.lit(False))
    return flags
