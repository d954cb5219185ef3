"""Heuristic and Sigma scenarios."""

import pytest
from pyspark.sql import functions as F

from hostwarden.functions import expr as X
from hostwarden.operators import heuristics as H, sigma as G
from hostwarden.sources import sigma_rules as R


def points(make_events, **row):
    return H.score(make_events([row])).first()["heuristic_score"]


@pytest.mark.parametrize("row, want", [
    ({"exe": "/tmp/backdoor", "name": "backdoor"}, 30),
    ({"exe": "/tmp/sshd", "name": "sshd"}, 80),
    ({"exe": "/usr/bin/firefox", "name": "firefox"}, 0),
    ({"exe": "/tmp/backup", "name": "backup", "at": -9 * 3600}, 40),
    ({"exe": "/usr/bin/x", "name": "x", "at": -6 * 3600}, 0),
    ({"exe": "/usr/bin/x", "name": "x", "at": -6 * 3600 - 1}, 10),
    ({"name": "sshd"}, 0),
    ({"name": "sshd", "exe": ""}, 0),
    ({"name": None, "exe": "/opt/sudo"}, 20),
    ({"name": "x7f2k9q3m1p5"}, 20),
    ({"source": "network", "kind": "suspicious_port"}, 25),
    ({"source": "network", "kind": "high_conn_rate", "count": 55}, 40),
    ({"source": "network", "kind": "high_conn_rate", "count": 20}, 0),
    ({"source": "network", "kind": "high_conn_rate"}, 0),
    ({"source": "network", "kind": "port_scan", "unique_ports": 20}, 0),
    ({"source": "network", "kind": "port_scan", "unique_ports": 21}, 45),
    ({"source": "filesystem", "kind": "file_modified", "path": "/etc/shadow"}, 60),
    ({"source": "filesystem", "kind": "rapid_changes", "count": 15}, 70),
    ({"source": "resource", "kind": "cpu_abuse", "cpu_pct": 95.0}, 50),
    ({"source": "process", "kind": "spawn_loop", "child_count": 21, "exe": "/tmp/a"}, 90),
])
def test_rule_points(make_events, row, want):
    assert points(make_events, **row) == want


def test_severity_thresholds(spark):
    scores = [0, 14, 15, 29, 30, 49, 50, 69, 70, 100]
    df = H.with_severity(spark.createDataFrame([(float(s),) for s in scores], "score double"))
    labels = [r["severity_label"] for r in df.orderBy("score").collect()]
    assert labels == ["INFO", "INFO", "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]


def test_gate_and_custom_rule(make_events):
    events = make_events([{"exe": "/usr/bin/a"}, {"exe": "/tmp/a"}])
    assert H.gate(H.score(events)).count() == 1
    rules = H.register_rule((), "all", "", lambda: F.lit(3))
    assert {r["heuristic_score"] for r in H.score(events, rules).collect()} == {3.0}


def test_entropy_and_number_text(spark):
    names = spark.createDataFrame([("",), ("aaaa",), ("ab",), ("x7f2k9q3m1p5",), ("йцук",)], "s string")
    got = [round(r[0], 3) for r in names.select(X.entropy(F.col("s"))).collect()]
    assert got == [0.0, 0.0, 1.0, 3.585, 2.0]
    values = [97.0, 0.5, 1e6, 1234567.0, 123456789.0, 1e-5, 0.00025, 0.0, -2.0, 999999.5]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(X.number_text(F.col("v")))
    want = ["97", "0.5", "1e+06", "1.234567e+06", "1.23456789e+08", "1e-05", "0.00025", "0", "-2", "999999.5"]
    assert [r[0] for r in df.collect()] == want


def test_entropy_of_whole_texts(spark):
    """A text of very many distinct characters, characters outside the basic plane, no text."""
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 4096))) * 4
    texts = spark.createDataFrame([("",), ("aaaa",), ("ab",), ("йцук",), ("a😀b😎",), (wide,), (None,)], "s string")
    assert [r[0] for r in texts.select(X.round6(X.entropy(F.col("s"), texts=True))).collect()] == [0.0, 0.0, 1.0, 2.0, 2.0, 12.0, None]


PROC = {"name": "Bash", "exe": "/tmp/x.sh", "kind": "new_process", "pid": 7}
NET = {"source": "network", "remote_port": 4444, "remote_addr": "10.0.0.1", "kind": "new_outbound", "pid": 7}


@pytest.mark.parametrize("detection, row, want", [
    ({"selection": {"name": "bash"}}, PROC, True),
    ({"selection": {"name|contains": "AS"}}, PROC, True),
    ({"selection": {"Image|startswith": "/tmp"}}, PROC, True),
    ({"selection": {"exe|endswith": ".sh"}}, PROC, True),
    ({"selection": {"exe|re": r"x\.s[g-i]$"}}, PROC, True),
    ({"selection": {"exe|re": "["}}, PROC, False),
    ({"selection": {"exe|re": "(?!x)"}}, PROC, False),
    ({"selection": {"name": ["zsh", "bash"], "exe|contains": ["/var/", "/tmp/"]}}, PROC, True),
    ({"selection": {"remote_port": 4444}}, NET, True),
    ({"selection": {"remote_port": [1, 4444]}}, NET, True),
    ({"selection": {"remote_port": 4444.0}}, NET, True),
    ({"selection": {"remote_port": True}}, NET, False),
    ({"selection": {"missing": "x"}}, NET, False),
    ({"selection": {"kind": "new_outbound"}}, NET, True),
    ({"selection": {"name": "*a*h"}}, PROC, True),
    ({"selection": {"name": "*"}}, PROC, True),
    ({"selection": {"name": "b*x"}}, PROC, False),
    ({"a": {"name": "bash"}, "b": {"name": "x"}, "condition": "a and not b"}, PROC, True),
    ({"a": {"name": "bash"}, "b": {"name": "x"}, "condition": "not a or b"}, PROC, False),
    ({"a": {"name": "bash"}, "b": {"name": "x"}, "condition": "b or a"}, PROC, True),
    ({"a": {"name": "bash"}, "b": {"name": "x"}, "condition": "a or b and b"}, PROC, False),
    ({"sel1": {"name": "bash"}, "sel2": {"name": "x"}, "condition": "1 of sel*"}, PROC, True),
    ({"sel1": {"name": "bash"}, "sel2": {"name": "x"}, "condition": "all of sel*"}, PROC, False),
    ({"condition": "all of none*"}, PROC, False),
    ({"selection": "text"}, PROC, False),
    ({"selection": [{"name": "x"}, {"name": "bash"}]}, PROC, True),
    ({"selection": {}}, PROC, True),
])
def test_detection_forms(make_events, detection, row, want):
    rule = {"title": "t", "level": "high", "category": "", "detection": detection}
    out = G.evaluate(make_events([row]), [rule]).first()
    assert (out["sigma_rules"] == ["t"]) is want
    assert out["sigma_bonus"] == (40.0 if want else 0.0)


def test_extra_fields_and_source_gate(spark, make_events):
    events = make_events([{"extra": {"Hashes": "abc"}}])
    rule = {"title": "t", "level": "low", "category": "process_creation", "detection": {"selection": {"Hashes": "ABC"}}}
    assert G.evaluate(events, [rule]).first()["sigma_rules"] == ["t"]
    assert G.evaluate(events, [{**rule, "category": "file_event"}]).first()["sigma_rules"] == []


def _wild(text, pattern):
    """Leftmost match of each piece in turn."""
    if pattern == "*":
        return True
    pieces, pos = pattern.split("*"), 0
    if not text.startswith(pieces[0]):
        return False
    pos = len(pieces[0])
    for piece in pieces[1:]:
        at = text.find(piece, pos)
        if at < 0:
            return False
        pos = at + len(piece)
    return pattern.endswith("*") or pos == len(text)


def test_wildcards_against_a_loop(spark):
    import itertools

    texts = ["".join(t) for n in range(5) for t in itertools.product("aX.", repeat=n)]
    patterns = ["*a", "a*", "a*a", "*a*a", "*.*", "a**a", "*X*a.", "**", ".*a*X"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    cols = [F.col("t").rlike(G.wildcard_regex(p)).alias(f"p{i}") for i, p in enumerate(patterns)]
    for row in df.select("t", *cols).collect():
        assert [row[f"p{i}"] for i in range(len(patterns))] == [_wild(row["t"], p) for p in patterns], row


def test_rule_folder(spark, tmp_path):
    (tmp_path / "b.yml").write_text("title: B\ndetection:\n  selection:\n    name: yes\n  condition: selection\nlevel: low\n")
    (tmp_path / "a.yml").write_text("title: [broken")
    (tmp_path / "c.yaml").write_text("title: C\ndetection: {selection: {name: x}}\n")
    (tmp_path / "d.yml").write_text("title: NoDetection\n")
    rules = R.rules_list(R.read_rules(spark, str(tmp_path), str(tmp_path / "missing")))
    assert [r["title"] for r in rules] == ["B"]
    assert rules[0]["detection"]["selection"] == {"name": "yes"}
    assert R.rules_list(R.read_rules(spark, str(tmp_path / "missing"))) == []
    shipped = tmp_path / "shipped"
    shipped.mkdir()
    R.write_rule_files(str(shipped))
    loaded = R.rules_list(R.read_rules(spark, str(shipped)))
    assert len(loaded) == 25 and [r["detection"] for r in loaded] == [r["detection"] for r in R.shipped_rules()]


def test_shipped_and_own_rules_together(spark, make_events, tmp_path):
    """Rules of the settings' folder come after the shipped ones; an explicit list replaces both."""
    from hostwarden.config import Config, CorrelatorConfig
    from hostwarden.plans.scoring import score_events
    from hostwarden.sources.sigma_rules import active_rules, read_rules, rules_list, shipped_rules, write_rule_files, write_rules

    own = {"title": "Own rule", "id": "own-1", "status": "test", "level": "high", "category": "", "product": "", "detection": {"selection": {"name": "xmrig"}, "condition": "selection"}, "tags": ["attack.t1", "mine"]}
    write_rule_files(str(tmp_path), [own])
    (tmp_path / "broken.yml").write_text("title: [")
    cfg = Config(sigma_rules_dir=str(tmp_path), correlator=CorrelatorConfig(enabled=False))
    loaded = active_rules(spark, str(tmp_path))
    assert [r["title"] for r in loaded] == [r["title"] for r in shipped_rules()] + ["Own rule"]
    assert (loaded[-1]["status"], loaded[-1]["tags"]) == ("test", ["attack.t1", "mine"])
    events = make_events([{"source": "process", "name": "xmrig", "exe": "/tmp/xmrig"}])
    hits = score_events(events, cfg).first()["sigma_rules"]
    assert hits[-1] == "Own rule" and len(hits) > 1
    assert score_events(events, cfg, sigma_rules=[own]).first()["sigma_rules"] == ["Own rule"]
    write_rules(spark, str(tmp_path / "parts"))
    again = rules_list(read_rules(spark, str(tmp_path / "parts"), pattern="*.txt"))
    assert [(r["id"], r["detection"]) for r in again] == [(r["id"], r["detection"]) for r in shipped_rules()]
