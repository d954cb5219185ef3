"""Engine settings as frozen dataclasses (driver-side only, never shipped to tasks)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

# --- fixed values: defaults that detection results depend on -----------------
SUSPICIOUS_PORTS = (
    4444, 5555, 6666, 8888, 9999, 1337, 31337,
    6667, 6697,
    3389, 5900, 5901, 5902,
    22,
    4443, 8443, 50050,
    1234, 12345, 54321, 3460, 7777, 9090,
    3333, 14444, 45700,
    1080, 9050, 9150,
)
TRUSTED_PROCESSES = (
    "systemd", "init", "kthreadd", "sshd", "cron", "crond",
    "kworker*", "ksoftirqd*", "migration*", "rcu_*",
    "NetworkManager", "wpa_supplicant", "dhclient", "dhcpcd",
    "systemd-resolved", "systemd-networkd", "avahi-daemon",
    "pulseaudio", "pipewire", "pipewire-pulse", "wireplumber",
    "Xorg", "Xwayland", "gnome-shell", "kwin*", "plasmashell",
    "gdm*", "sddm", "lightdm",
    "dbus-daemon", "dbus-broker", "polkitd",
    "apt", "dpkg", "pacman", "dnf", "yum", "zypper", "flatpak",
    "systemd-journald", "rsyslogd", "auditd",
    "udisksd", "upower", "thermald", "irqbalance",
    "accounts-daemon", "colord", "fwupd",
    "code", "code-oss", "node", "npm", "npx",
    "python3", "python", "go", "cargo", "rustc", "java", "gradle",
    "chrome", "chromium", "firefox", "brave-browser", "agent-browser",
)
EXEMPT_PROCESSES = ("systemd", "init", "kthreadd", "sshd", "kwin*", "plasmashell", "gnome-shell")
WATCHED_PATHS = (
    "/etc/passwd", "/etc/shadow", "/etc/sudoers", "/etc/group", "/etc/gshadow",
    "/etc/ssh/sshd_config", "/etc/ssh/ssh_config",
    "/etc/crontab", "/etc/cron.d", "/etc/anacrontab",
    "/etc/hosts", "/etc/resolv.conf", "/etc/nsswitch.conf",
    "/etc/rc.local", "/etc/environment", "/etc/profile", "/etc/ld.so.preload",
    "/etc/pam.d",
    "/etc/iptables", "/etc/nftables.conf",
)
# --- end of fixed values ------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    """Entity risk-state boundaries and linear decay."""

    watching: float = 15.0
    suspicious: float = 35.0
    threat: float = 65.0
    blocked: float = 90.0
    decay_per_minute: float = 5.0
    tick_sec: int = 30
    evict_after_sec: int = 600

    @property
    def decay_per_tick(self) -> float:
        return self.decay_per_minute * self.tick_sec / 60.0


@dataclass(frozen=True)
class CorrelatorConfig:
    enabled: bool = True
    time_window_sec: int = 60
    two_source_mult: float = 1.5
    three_source_mult: float = 2.5
    prune_every_sec: int = 300
    retention_sec: int = 600


@dataclass(frozen=True)
class AnomalyConfig:
    enabled: bool = True
    num_trees: int = 100
    sample_size: int = 256
    max_buffer: int = 1000
    drift_threshold: float = 2.0
    drift_window_size: int = 200
    fp_rate_threshold: float = 0.3
    min_feedback: int = 10
    check_interval_min: int = 5
    min_training_rows: int = 10
    window_sec: int = 300
    seed: int = 42


@dataclass(frozen=True)
class ThreatIntelConfig:
    cache_ttl_minutes: int = 1440


@dataclass(frozen=True)
class ResourceGuardConfig:
    enabled: bool = True
    cpu_threshold: float = 85.0
    memory_threshold_mb: int = 4096
    sustained_seconds: int = 30
    action: str = "notify"  # notify | renice | kill
    renice_value: int = 19
    exempt_processes: tuple[str, ...] = EXEMPT_PROCESSES
    spawn_loop_window_sec: int = 60
    spawn_loop_limit: int = 10
    cooldown_sec: int = 60
    kill_in_flight_sec: int = 5


@dataclass(frozen=True)
class Config:
    """The whole settings tree; ``load`` overlays a JSON file on the defaults."""

    scan_interval_seconds: int = 10
    learning_period_minutes: int = 5
    thresholds: Thresholds = field(default_factory=Thresholds)
    watched_paths: tuple[str, ...] = WATCHED_PATHS
    suspicious_ports: tuple[int, ...] = SUSPICIOUS_PORTS
    trusted_processes: tuple[str, ...] = TRUSTED_PROCESSES
    firewall_enabled: bool = False
    correlator: CorrelatorConfig = field(default_factory=CorrelatorConfig)
    anomaly: AnomalyConfig = field(default_factory=AnomalyConfig)
    threat_intel: ThreatIntelConfig = field(default_factory=ThreatIntelConfig)
    resource_guard: ResourceGuardConfig = field(default_factory=ResourceGuardConfig)
    sigma_rules_dir: str = ""


def _overlay(base, data: dict):
    known = {f.name for f in fields(base)}
    changes = {}
    for key, value in data.items():
        if key not in known:
            continue
        current = getattr(base, key)
        if hasattr(current, "__dataclass_fields__") and isinstance(value, dict):
            changes[key] = _overlay(current, value)
        else:
            changes[key] = tuple(value) if isinstance(value, list) else value
    return replace(base, **changes)


def load(path: str) -> Config:
    """Defaults overlaid with the JSON file at ``path``; a missing file means defaults."""
    try:
        with open(path, encoding="utf-8") as handle:
            return _overlay(Config(), json.load(handle))
    except FileNotFoundError:
        return Config()


def dump(cfg: Config) -> str:
    return json.dumps(asdict(cfg), indent=2)
