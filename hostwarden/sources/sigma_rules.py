"""Detection-rule sources: a folder of ``.yml`` files, and the shipped rule set."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from hostwarden import schema

_INTERPRETERS = ["bash", "sh", "dash", "zsh", "python", "python3", "perl", "ruby", "nc", "ncat", "socat"]


def _simple(**fields) -> dict:
    return {"selection": fields, "condition": "selection"}


# fixed values: the shipped rules, in load order: (id, title, level, category, detection)
SHIPPED_RULES: tuple[tuple[str, str, str, str, dict], ...] = (
    ("sigma-009", "Crontab File Modified", "high", "file_event", _simple(path="/etc/crontab")),
    ("sigma-011", "Hosts File Modified", "medium", "file_event", _simple(path="/etc/hosts")),
    ("sigma-012", "Passwd File Modified", "high", "file_event", _simple(path="/etc/passwd")),
    ("sigma-007", "Shadow File Modified", "critical", "file_event", _simple(path="/etc/shadow")),
    ("sigma-010", "SSHD Config Modified", "high", "file_event", _simple(path="/etc/ssh/sshd_config")),
    ("sigma-008", "Sudoers File Modified", "critical", "file_event", _simple(path="/etc/sudoers")),
    ("sigma-004", "Connection to Known C2 Port", "high", "network_connection",
     _simple(remote_port=[4444, 5555, 6666, 8888, 9999, 1337])),
    ("sigma-005", "IRC Channel Connection", "medium", "network_connection", _simple(remote_port=[6667, 6697])),
    ("sigma-024", "Internal Port Scan Detected", "high", "network_connection", _simple(kind="port_scan")),
    ("sigma-006", "Outbound RDP or VNC Connection", "medium", "network_connection", _simple(remote_port=[3389, 5900])),
    ("sigma-014", "SSH Connection to Internal Host", "medium", "network_connection",
     _simple(**{"remote_port": 22, "remote_addr|startswith": ["10.", "192.168.", "172.16.", "172.17.", "172.18."]})),
    ("sigma-018", "Connection to Tor Network Port", "high", "network_connection", _simple(remote_port=[9050, 9150])),
    ("sigma-020", "Scheduled Task Creation", "medium", "process_creation", _simple(name=["at", "crontab"])),
    ("sigma-017", "File Permission Change via chmod", "low", "process_creation", _simple(name="chmod")),
    ("sigma-019", "Compiler Execution from Suspicious Path", "medium", "process_creation",
     _simple(**{"name": ["gcc", "g++", "cc", "make"], "exe|contains": ["/tmp/", "/dev/shm/"]})),
    ("sigma-013", "Potential Crypto Miner Process", "medium", "process_creation",
     _simple(**{"name|contains": ["xmrig", "minerd", "cpuminer", "cgminer", "bfgminer", "ethminer", "stratum"]})),
    ("sigma-015", "System Enumeration Tools", "low", "process_creation",
     _simple(name=["whoami", "id", "uname", "hostname", "ifconfig", "ip", "netstat", "ss", "lsof", "ps", "cat"])),
    ("sigma-003", "System Process Name Mimicry", "high", "process_creation",
     {"selection_sshd": {"name": "sshd"}, "filter_sshd": {"exe|startswith": "/usr/sbin/"},
      "selection_systemd": {"name": "systemd"}, "filter_systemd": {"exe|startswith": "/usr/lib/systemd/"},
      "condition": "(selection_sshd and not filter_sshd) or (selection_systemd and not filter_systemd)"}),
    ("sigma-023", "Privilege Escalation Attempt", "high", "process_creation",
     _simple(ProcessName=["su", "sudo", "pkexec", "runuser", "newgrp"])),
    ("sigma-021", "Process Sustained CPU Abuse", "high", "resource_event", _simple(kind=["cpu_abuse", "memory_abuse"])),
    ("sigma-002", "Potential Reverse Shell Process", "high", "process_creation",
     {"selection": {"name": _INTERPRETERS},
      "filter": {"exe|startswith": ["/usr/bin/", "/usr/sbin/", "/bin/", "/sbin/"]}, "condition": "selection"}),
    ("sigma-025", "Interpreter Executing Script From Temp Directory", "high", "process_creation",
     _simple(**{"ProcessName": ["bash", "sh", "python", "python3", "perl", "ruby", "node"],
                "exe|contains": ["/tmp/", "/var/tmp/", "/dev/shm/"]})),
    ("sigma-022", "Process Spawn Loop Detected", "high", "process_creation", _simple(kind="spawn_loop")),
    ("sigma-001", "Process Started From Suspicious Path", "medium", "process_creation",
     _simple(**{"exe|contains": ["/tmp/", "/var/tmp/", "/dev/shm/"]})),
    ("sigma-016", "Download Tool Execution from Suspicious Path", "medium", "process_creation",
     {"selection": {"name": ["wget", "curl"]}, "filter": {"exe|startswith": ["/usr/bin/", "/usr/sbin/"]},
      "condition": "selection"}),
)


_RULE_COLUMNS = [part.split()[0] for part in schema.RULES_DDL.split(", ")]


def shipped_rules() -> list[dict]:
    """The shipped rules as plain dicts."""
    return [
        {"id": i, "title": t, "status": "stable", "level": lv, "category": c, "product": "", "detection": d, "tags": []}
        for i, t, lv, c, d in SHIPPED_RULES
    ]


def _loader():
    """A YAML 1.2-style loader: only true/false are booleans (``yes`` and ``on`` stay text)."""
    import yaml

    class RuleLoader(yaml.SafeLoader):
        pass

    RuleLoader.yaml_implicit_resolvers = {
        first: [(tag, rx) for tag, rx in items if tag != "tag:yaml.org,2002:bool"]
        for first, items in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    import re

    RuleLoader.add_implicit_resolver(
        "tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF")
    )
    return yaml, RuleLoader


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, (dict, list)):
        raise TypeError("expected a scalar")
    return str(value)


def parse_rule(text: str) -> dict | None:
    """One YAML document to a rule row; None when it cannot be parsed or is not a rule."""
    yaml, loader = _loader()
    try:
        doc = yaml.load(text, Loader=loader)  # noqa: S506 - subclass of SafeLoader
        if not isinstance(doc, dict):
            return None
        source = doc.get("logsource") or {}
        detection = doc.get("detection")
        title = _text(doc.get("title"))
        if detection is not None and not isinstance(detection, dict):
            return None
        if not title or detection is None:
            return None
        return {
            "title": title, "id": _text(doc.get("id")), "status": _text(doc.get("status")),
            "level": _text(doc.get("level")), "category": _text(source.get("category")),
            "product": _text(source.get("product")),
            "detection": json.dumps(detection, default=str),
            "tags": [_text(t) for t in (doc.get("tags") or [])],
        }
    except (yaml.YAMLError, TypeError, AttributeError):
        return None


def read_rules(spark: SparkSession, *dirs: str, pattern: str = "*.yml") -> DataFrame:
    """Rules table from folders, not recursive, in folder then file-name order; bad files are skipped."""
    out = None
    for position, folder in enumerate(dirs):
        try:
            files = (
                spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "false")
                .text(folder, wholetext=True)
                .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("body"))
            )
        except AnalysisException:
            continue
        part = files.mapInPandas(_parse_batches, schema.RULES_DDL).withColumn("dir_no", F.lit(position))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema.RULES_DDL + ", dir_no int")
    return out


def _parse_batches(batches):
    for batch in batches:
        rows = []
        for name, body in zip(batch["file"], batch["body"]):
            rule = parse_rule(body)
            if rule is None:
                print(f"rule file skipped: {name}")
            else:
                rows.append({**rule, "file": name})
        yield pd.DataFrame(rows, columns=_RULE_COLUMNS)


def rules_list(rules: DataFrame) -> list[dict]:
    """Bring a rules table to the driver for compilation. Rules are configuration: one small file each."""
    rows = rules.orderBy("dir_no", "file").collect()
    return [{**row.asDict(), "detection": json.loads(row["detection"])} for row in rows]


def rules_table(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    """Rules as a table, with their load order."""
    items = shipped_rules() if rules is None else rules
    rows = [
        (n, r["id"], r["title"], r["level"], r["category"], json.dumps(r["detection"])) for n, r in enumerate(items)
    ]
    return spark.createDataFrame(
        rows, "rule_no int, id string, title string, level string, category string, detection string"
    )


def active_rules(spark: SparkSession, *dirs: str) -> list[dict]:
    """The shipped rules, then those of the given folders (empty names are skipped), in load order."""
    folders = [d for d in dirs if d]
    return [*shipped_rules(), *(rules_list(read_rules(spark, *folders)) if folders else [])]


def rule_text(rule: dict) -> str:
    """A rule as the text of its file."""
    yaml, _ = _loader()
    return yaml.safe_dump({
        "title": rule["title"], "id": rule["id"], "status": rule.get("status") or "stable", "level": rule["level"],
        "logsource": {"category": rule["category"], "product": rule["product"]}, "detection": rule["detection"], "tags": rule.get("tags") or [],
    }, sort_keys=False)


def write_rules(spark: SparkSession, folder: str, rules: list[dict] | None = None) -> None:
    """Rules through Spark's text writer, one file each (``part-*.txt``, so read them with ``pattern="*.txt"``), in load order."""
    texts = [(n, rule_text(rule)) for n, rule in enumerate(shipped_rules() if rules is None else rules)]
    if texts:
        table = spark.createDataFrame(texts, "rule_no int, value string")
        table.repartitionByRange(len(texts), "rule_no").select("value").write.text(folder)


def write_rule_files(folder: str, rules: list[dict] | None = None) -> None:
    """Write rules as one ``.yml`` per rule into a local folder, numbered so that file-name order is load order."""
    import os

    for n, rule in enumerate(shipped_rules() if rules is None else rules):
        with open(os.path.join(folder, f"{n:03d}_{rule['id']}.yml"), "w", encoding="utf-8") as handle:
            handle.write(rule_text(rule))
