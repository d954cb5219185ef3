"""Correlation, pattern, graph and feedback scenarios, and a brute-force comparison on skewed data."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hostwarden.config import CorrelatorConfig
from hostwarden.operators import correlation as C, feedback as B, graph as G
from hostwarden.operators.patterns import DEFAULT_PATTERNS
from tests.conftest import SEC, T0

P, N, FS, RES = "process", "network", "filesystem", "resource"


def last(make_events, rows):
    df = make_events([{"pid": 100, **r} for r in rows]).withColumn("heuristic_score", F.lit(10.0))
    return C.correlate(df).orderBy(F.desc("ts"), F.desc("seq")).first()


def test_multiplier_by_sources(make_events):
    rows = [{"source": P}, {"source": N, "at": 1}, {"source": FS, "at": 2}]
    got = C.correlate(make_events([{"pid": 100, **r} for r in rows])).orderBy("seq").collect()
    assert [r["multiplier"] for r in got] == [1.0, 1.5, 2.5]


def test_no_pid_is_skipped(make_events):
    got = C.correlate(make_events([{"pid": 0}, {"pid": None}])).collect()
    assert [(r["multiplier"], r["patterns"], r["related_count"]) for r in got] == [(None, [], 0)] * 2


@pytest.mark.parametrize("rows, want", [
    ([{"source": P, "exe": "/tmp/backdoor"}, {"source": N, "remote_port": 4444, "at": 1}], ["reverse_shell"]),
    ([{"source": P, "exe": "/usr/bin/a"}, {"source": N, "remote_port": 4444, "at": 1}], []),
    ([{"source": P, "exe": "/tmp/backdoor"}, {"source": N, "remote_port": 4444, "at": 60}], []),
    ([{"source": P}, {"source": N, "count": 25, "at": 1}, {"source": FS, "path": "/etc/shadow", "at": 2}], ["data_exfiltration"]),
    ([{"source": P}, {"source": FS, "path": "/etc/crontab", "at": 1}], ["persistence"]),
    ([{"source": P}, {"source": N, "remote_port": 22, "remote_addr": "192.168.1.5", "at": 1}], ["lateral_movement"]),
    ([{"source": P}, {"source": N, "remote_port": 22, "remote_addr": "8.8.8.8", "at": 1}], []),
    ([{"source": P, "name": "x7f2k9q3m1p5"}, {"source": N, "at": 1}], ["crypto_miner"]),
    ([{"source": P, "child_count": 12}, {"source": RES, "cpu_pct": 99.0, "at": 1}], ["runaway_fork"]),
    ([{"source": N, "remote_port": 22, "remote_addr": "8.8.8.8", "at": i, "entity_id": f"n{i}"} for i in range(5)], ["beaconing", "ssh_brute_force"]),
    ([{"source": N, "remote_port": 22, "at": i, "entity_id": "same"} for i in range(5)], []),
])
def test_patterns(make_events, rows, want):
    assert last(make_events, rows)["patterns"] == want


def test_replaced_node_no_longer_counts(make_events):
    rows = [
        {"source": P, "exe": "/tmp/x", "entity_id": "p"}, {"source": P, "exe": "/usr/bin/x", "entity_id": "p", "at": 1},
        {"source": N, "remote_port": 4444, "at": 2},
    ]
    assert last(make_events, rows)["patterns"] == []


@pytest.mark.parametrize("gaps, want", [([60] * 9, True), ([1, 15, 3, 120, 2, 90, 5, 200, 1, 50], False), ([60, 60], False), ([0.5] * 9, False)])
def test_beacon_test(spark, gaps, want):
    times = [T0]
    for g in gaps:
        times.append(times[-1] + int(g * SEC))
    df = spark.createDataFrame([(times,)], "t array<bigint>")
    assert df.select(C.is_regular(F.col("t"))).first()[0] is want


def brute(rows, cfg):
    """One event at a time over plain dictionaries, keyed as documented by (pid, entity)."""
    nodes, beacons, out = {}, {}, {}
    grid, keep, window = cfg.prune_every_sec * SEC, cfg.retention_sec * SEC, cfg.time_window_sec * SEC
    for r in sorted(rows, key=lambda r: (r["us"], r["seq"])):
        now, pid = r["us"], r["pid"]
        cutoff = now // grid * grid - keep
        mine = nodes.setdefault(pid, {})
        for k in [k for k, n in mine.items() if n["us"] < cutoff]:
            del mine[k]
        if r["source"] == N and r.get("remote_addr"):
            history = [t for t in beacons.get((pid, r["remote_addr"]), []) if t > cutoff]
            beacons[pid, r["remote_addr"]] = (history + [now])[-20:]
        mine[r["entity_id"]] = r
        live = [n for n in mine.values() if n["us"] > now - window]
        related = sorted(n["entity_id"] for n in live if n["entity_id"] != r["entity_id"])

        def regular(n):
            times = [t for t in beacons.get((pid, n.get("remote_addr")), []) if t > cutoff]
            if len(times) < 5:
                return False
            gaps = [(b - a) / SEC for a, b in zip(times, times[1:])]
            mean = sum(gaps) / len(gaps)
            return mean >= 1 and (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 < mean * 0.15

        names = []
        has = lambda f: any(f(n) for n in live)
        if has(lambda n: n["source"] == P and "/tmp/" in (n.get("exe") or "")) and has(lambda n: n["source"] == N and n.get("remote_port") == 4444):
            names.append("reverse_shell")
        if has(lambda n: n["source"] == P) and has(lambda n: n["source"] == FS and n.get("path") == "/etc/crontab"):
            names.append("persistence")
        if has(lambda n: n["source"] == N and n.get("remote_addr") and regular(n)):
            names.append("beaconing")
        if sum(n["source"] == N and n.get("remote_port") == 22 for n in live) >= 5:
            names.append("ssh_brute_force")
        out[r["seq"]] = (len({n["source"] for n in mine.values()}), related, [n for n in names])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_with_a_hot_pid(spark, make_events, seed):
    rng = random.Random(seed)
    rows, clock = [], 0.0
    for n in range(900):
        clock += rng.choice([0, 0, 0.5, 3, 7, 20, 61]) if n % 150 else 700
        pid = 1 if rng.random() < 0.5 else rng.randint(2, 5)
        kind = rng.choice([P, N, N, N, FS])
        row = {"seq": n, "at": clock, "pid": pid, "source": kind}
        if kind == P:
            row.update(entity_id=f"p{rng.randint(0, 2)}", exe=rng.choice(["/tmp/x", "/usr/x"]), name="x")
        elif kind == N:
            addr, port = f"9.9.9.{rng.randint(0, 1)}", rng.choice([22, 4444, 80, 443, 8080])
            row.update(entity_id=f"net:{addr}:{port}", remote_addr=addr, remote_port=port)
        else:
            row.update(entity_id="f", path=rng.choice(["/etc/crontab", "/etc/hosts"]))
        rows.append(row)
    # a regular beacon that crosses several prune lines
    for i in range(60):
        rows.append({"seq": 5000 + i, "at": 20.0 * i + 3, "pid": 9, "source": N, "entity_id": "net:7.7.7.7:443", "remote_addr": "7.7.7.7", "remote_port": 443})
    want = brute([{**r, "us": T0 + int(round(r["at"] * SEC))} for r in rows], CorrelatorConfig())
    events = make_events(rows)
    keep = [p for p in DEFAULT_PATTERNS if p.name in ("reverse_shell", "persistence", "beaconing", "ssh_brute_force")]
    got = C.correlated_with(C.correlate(events, patterns=keep)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["source_count"], r["correlated_with"], r["patterns"]) == want[r["seq"]], r
        assert r["related_count"] == len(want[r["seq"]][1])


def test_same_result_for_any_partitioning(spark, make_events):
    rng = random.Random(5)
    events = make_events([
        {"at": i * 2.5, "pid": rng.randint(1, 3), "source": rng.choice([P, N, FS]), "entity_id": f"e{rng.randint(0, 6)}", "exe": "/tmp/a", "remote_port": 4444}
        for i in range(300)
    ])
    results = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(map(str, C.correlate(events).select("seq", "multiplier", "patterns", "related_count").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_bfs_stops_after_three_hops(spark):
    edges = spark.createDataFrame([("h", a, b) for a, b in ("ab", "bc", "cd", "de")], "host_id string, from_id string, to_id string")
    nodes = spark.createDataFrame([("h", x) for x in "abde"], "host_id string, entity_id string")
    start = spark.createDataFrame([("h", "a")], "host_id string, entity_id string")
    got = {(r["entity_id"], r["hop"]) for r in G.related_by(edges, nodes, start).collect()}
    assert got == {("b", 1), ("d", 3)}  # c has no node: walked through, not returned


def test_prune(spark, make_events):
    events = make_events([{"entity_id": "old", "pid": 1}, {"entity_id": "new", "pid": 1, "at": 1200}]).withColumn("score", F.lit(1.0))
    live = G.prune_nodes(G.nodes(events), F.timestamp_micros(F.lit(T0 + 1200 * SEC)))
    assert [r["entity_id"] for r in live.collect()] == ["new"]
    edges = spark.createDataFrame([("h", "old", "new")], "host_id string, from_id string, to_id string")
    assert G.prune_edges(edges, live).count() == 0


def test_feedback_weights(spark):
    rows = [("a", False)] * 10 + [("b", i < 5) for i in range(10)] + [("c", i < 2) for i in range(5)]
    labels = spark.createDataFrame([("e", n, fp, None) for n, fp in rows], "entity_id string, rule_name string, false_positive boolean, ts timestamp")
    rules = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("none", 50.0), ("c", 100.0)], "rule_name string, base_weight double")
    got = {r["rule_name"]: round(r["effective_weight"], 6) for r in B.effective_weights(rules, B.stats(labels)).collect()}
    assert got == {"a": 100.0, "b": 25.0, "none": 50.0, "c": 36.0}
    rate = B.fp_rate(labels).first()
    assert (rate["labels"], rate["false_positives"], rate["exceeded"]) == (25, 7, False)


def test_edges_around_entities(spark, make_events):
    """Edges built around some entities are those of all edges that end there; a walk from one process leaves the others alone."""
    rng = random.Random(12)
    rows = [{"seq": k, "at": rng.randrange(900), "pid": 1 + k % 12, "entity_id": f"e{1 + k % 12}.{rng.randrange(6)}" if k % 12 else f"e{rng.choice([1, 2])}.0", "source": "process"} for k in range(600)]
    events = make_events(rows)
    whole = G.same_pid_edges(events)
    for names in (["e1.0"], ["e3.1", "e3.2", "e7.0"], ["nothing"]):
        near = spark.createDataFrame([("h", n) for n in names], "host_id string, entity_id string")
        want = whole.where(F.col("from_id").isin(names) | F.col("to_id").isin(names))
        got = G.same_pid_edges(events, near=near)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert got.count() < whole.count() / 2
    start = spark.createDataFrame([("h", "e1.0")], "host_id string, entity_id string")
    node_table = G.nodes(events.withColumn("score", F.lit(1.0)))
    walked = {(r["entity_id"], r["hop"]) for r in G.related_to(events, node_table, start).collect()}
    assert walked == {(r["entity_id"], r["hop"]) for r in G.related_by(whole, node_table, start).collect()}
    assert walked and all(n.split(".")[0] in ("e1", "e2") for n, _ in walked)
    own, edges = G.for_pid(events.withColumn("score", F.lit(1.0)), 5)
    assert {r["entity_id"].split(".")[0] for r in own.collect()} == {"e5"} and all(r["pid"] == 5 for r in edges.collect())


def test_sorts_do_not_begin_with_the_host(make_events):
    """A host name is the same in most rows: as the first sort column it makes every comparison read both rows."""
    from hostwarden.operators import anomaly_features as A

    events = make_events([{"pid": n % 3, "source": N, "remote_addr": "1.2.3.4", "at": n} for n in range(12)])
    for df in (C.correlate(events), A.extract(events)):
        sorts = re.findall(r"Sort \[([^]]*)\]", df._jdf.queryExecution().executedPlan().toString())
        wide = [s for s in sorts if not re.fullmatch(r"host_id#\d+ ASC NULLS FIRST, _chunk#\d+L ASC NULLS FIRST", s)]  # one row a chunk
        assert wide and not any(s.startswith("host_id") for s in wide)


@pytest.mark.parametrize("gap", [1, 1.2, 0.9])
def test_beacons_with_and_without_a_prune(make_events, gap):
    """Histories of fewer than five times are no beacon; longer ones by the times within retention."""
    rows = [{"pid": 9, "source": N, "remote_addr": "1.2.3.4", "at": n * gap} for n in range(7)]
    got = C.beacon_flags(make_events(rows)).orderBy("seq").collect()
    assert [r["beacon_now"] for r in got] == [n >= 4 and gap >= 1 for n in range(7)]
    assert [r["beacon_next"] for r in got] == [n >= 4 and gap >= 1 for n in range(7)]
