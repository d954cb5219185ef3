"""Snapshot monitors against per-scan loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hostwarden.config import Config, ResourceGuardConfig
from hostwarden.operators import file_monitor as FM, network_monitor as N, process_monitor as P, resource_monitor as R, scan
from tests.conftest import SEC, T0


def stamped(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl).withColumn("scan_ts", F.timestamp_micros("scan_ts"))


def test_new_process_and_learning(spark):
    ddl = "host_id string, scan_ts bigint, seq bigint, pid int, name string, exe string, created timestamp, ppid int"
    scan = lambda n, *pids: [("h", T0 + n * 10 * SEC, n * 100 + p, p, f"n{p}" if p != 9 else "firefox", "/x", None, 1) for p in pids]
    snaps = stamped(spark, scan(0, 1, 2) + scan(1, 1, 3, 9) + scan(2, 1, 2, 3), ddl)
    got = sorted((r["seq"], r["entity_id"]) for r in P.new_process_events(snaps).collect())
    assert got == [(1, "proc:1:n1"), (2, "proc:2:n2"), (103, "proc:3:n3"), (202, "proc:2:n2")]
    later = P.new_process_events(snaps, Config(), F.timestamp_micros(F.lit(T0 + 10 * SEC)))
    assert sorted(r["seq"] for r in later.collect()) == [103, 202]
    gone = P.disappeared(snaps, ["pid"]).collect()
    assert sorted((r["scan_no"], r["pid"]) for r in gone) == [(2, 2), (3, 9)]
    assert P.known_count(snaps).first()["process_count"] == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_spawn_count_against_loop(spark, seed):
    rng = random.Random(seed)
    rows = [("h", T0 + rng.randint(0, 40) * 20 * SEC, n, n, "n", "/x", None, rng.choice([0, 1, 1, 1, 2])) for n in range(300)]
    ddl = "host_id string, scan_ts bigint, seq bigint, pid int, name string, exe string, created timestamp, ppid int"
    got = {r["seq"]: r["spawn_count"] for r in P.spawn_counts(stamped(spark, rows, ddl), 60).collect()}
    want = {}
    for r in rows:
        if r[7] > 0:
            want[r[2]] = sum(1 for q in rows if q[7] == r[7] and r[1] - 60 * SEC <= q[1] and (q[1], q[2]) <= (r[1], r[2]))
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_network_against_loop(spark, seed):
    rng = random.Random(seed)
    rows, seq = [], 0
    for scan in range(14):
        t = T0 + scan * rng.choice([10, 25]) * SEC + scan * 10 * SEC
        for _ in range(rng.randint(5, 30)):
            port = rng.choice([22, 443, 4444] + list(range(2000, 2030)))
            rows.append(("h", t, seq, rng.choice([1, 1, 1, 2]), rng.choice(["ESTABLISHED"] * 5 + ["SYN_SENT", "LISTEN"]), rng.randint(1, 2), rng.choice(["1.1.1.1", "127.0.0.1", "2.2.2.2", ""]), port))
            seq += 1
    ddl = "host_id string, scan_ts bigint, seq bigint, pid int, status string, local_port int, remote_addr string, remote_port int"
    events = N.events(stamped(spark, rows, ddl)).collect()
    got = sorted((r["seq"], r["kind"], r["count"], r["unique_ports"]) for r in events)
    want, known, reset = [], set(), None
    counts, ports, rated, scanned = {}, {}, set(), set()
    for t in sorted({r[1] for r in rows}):
        if reset is None or t - reset > 60 * SEC:
            counts, ports, rated, scanned, reset = {}, {}, set(), set(), t
        current = set()
        for _, _, s, pid, status, lp, addr, port in sorted((r for r in rows if r[1] == t), key=lambda r: r[2]):
            if status not in ("ESTABLISHED", "SYN_SENT") or addr in ("127.0.0.1", ""):
                continue
            key = (lp, addr, port, pid)
            is_new = key not in known
            known.add(key)
            current.add(key)
            counts[pid] = counts.get(pid, 0) + 1
            ports.setdefault(pid, set()).add(port)
            if not is_new:
                continue
            if len(ports[pid]) >= 20 and pid not in scanned:
                scanned.add(pid)
                want.append((s, "port_scan", None, len(ports[pid])))
            if port in Config().suspicious_ports:
                want.append((s, "suspicious_port", None, None))
            elif counts[pid] > 20:
                if pid not in rated:
                    rated.add(pid)
                    want.append((s, "high_conn_rate", counts[pid], None))
            else:
                want.append((s, "new_outbound", None, None))
        known &= current
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_file_changes_keep_the_last_seen_state(spark):
    rows = [("h", T0, "/a", "1", None, 10), ("h", T0 + 30 * SEC, "/b", "x", None, 1), ("h", T0 + 86500 * SEC, "/a", "2", None, 20), ("h", T0 + 86530 * SEC, "/a", "2", None, 20)]
    files = stamped(spark, rows, "host_id string, scan_ts bigint, path string, hash string, mtime timestamp, size bigint")
    got = FM.events(files).collect()
    assert [(r["path"], r["prev_hash"], r["new_hash"], r["prev_size"], r["new_size"]) for r in got] == [("/a", "1", "2", 10, 20)]


def test_raw_file_source(spark, tmp_path):
    from hostwarden.sources.tables import file_states_from_content

    (tmp_path / "f").write_bytes(b"abc")
    (tmp_path / "dir").mkdir()
    rows = file_states_from_content(spark, str(tmp_path), "h", "2024-01-01 00:00:00").collect()
    assert [(r["hash"][:8], r["size"]) for r in rows] == [("ba7816bf", 3)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_resource_guard_against_loop(spark, seed):
    rng = random.Random(seed)
    rows, seq = [], 0
    for scan in range(200):
        for pid in range(1, 6):
            if rng.random() < 0.1:
                continue
            cpu = {1: 97.3, 2: rng.choice([88.1] * 9 + [20.0]), 3: rng.uniform(0, 100), 4: 90.0 if scan > 100 else 5.0, 5: 99.9}[pid]
            name = {1: "a", 2: "b", 3: "c", 4: "d", 5: "a"}[pid]
            rows.append(("h", T0 + scan * 10 * SEC, seq, pid, name, "/x", float(cpu), rng.choice([1, 4095, 4096, 5000]) * 1048576 + 7))
            seq += 1
    ddl = "host_id string, scan_ts bigint, seq bigint, pid int, name string, exe string, cpu_pct double, rss_bytes bigint"
    got = sorted((r["seq"], r["kind"]) for r in R.events(stamped(spark, rows, ddl)).collect())
    cfg = ResourceGuardConfig()
    stats, hist, alerts, want, active = {}, {}, {}, [], set()
    for t in sorted({r[1] for r in rows}):
        current = [r for r in rows if r[1] == t]
        for _, _, s, pid, name, _, cpu, rss in sorted(current, key=lambda r: r[2]):
            n, mean, m2 = stats.get(name, (0, 0.0, 0.0))
            n, off = n + 1, cpu - mean
            mean += off / n
            m2 += off * (cpu - mean)
            stats[name] = (n, mean, m2)
            limit = max(cfg.cpu_threshold, mean + 3 * (math.sqrt(m2 / (n - 1)) if n > 1 else 0.0))
            hist.setdefault(pid, []).append((t, cpu))
            recent = [c for u, c in hist[pid] if u > t - 30 * SEC]
            if len(recent) >= 2 and all(c >= limit - 1e-9 for c in recent) and t - alerts.get((pid, "cpu"), -10**18) >= 60 * SEC:
                alerts[pid, "cpu"] = t
                want.append((s, "cpu_abuse"))
            if rss // 1048576 >= 4096 and t - alerts.get((pid, "mem"), -10**18) >= 60 * SEC:
                alerts[pid, "mem"] = t
                want.append((s, "memory_abuse"))
        present = {r[3] for r in current}
        for pid in active - present:
            hist.pop(pid, None)
            alerts.pop((pid, "cpu"), None)
            alerts.pop((pid, "mem"), None)
        active = present
    assert got == sorted(want)


def test_events_of_all_monitors_have_their_own_keys_and_are_scored_once(spark):
    from hostwarden.plans.monitoring import monitored_events
    from hostwarden.plans.scoring import score_events

    rows = [("h", T0, 1, 1, "init", "/sbin/init", None, 0)] + [("h", T0 + 10 * SEC, 10 + k, 100 + k, f"c{k}", "/tmp/c", None, 1) for k in range(12)]
    procs = stamped(spark, rows + [("h", T0 + 10 * SEC, 9, 1, "init", "/sbin/init", None, 0)], "host_id string, scan_ts bigint, seq bigint, pid int, name string, exe string, created timestamp, ppid int")
    conns = stamped(spark, [("h", T0 + 10 * SEC, k, 100, "ESTABLISHED", 5000 + k, "198.51.100.7", 4000 + k) for k in range(25)], "host_id string, scan_ts bigint, seq bigint, pid int, status string, local_port int, remote_addr string, remote_port int")
    files = stamped(spark, [("h", T0 + n * 10 * SEC, path, f"{n}", None, 5) for n in range(2) for path in ("/etc/passwd", "/etc/shadow")], "host_id string, scan_ts bigint, path string, hash string, mtime timestamp, size bigint")
    events = monitored_events(procs, conns, files)
    got = events.collect()
    assert len({(r["host_id"], r["seq"]) for r in got}) == len(got) and {"new_process", "spawn_loop", "file_modified", "rapid_changes"} <= {r["kind"] for r in got}
    assert [r["ts"] for r in sorted(got, key=lambda r: r["seq"])] == sorted(r["ts"] for r in got)
    scored = score_events(events, gate=False).select("seq").collect()
    assert sorted(r["seq"] for r in scored) == sorted(r["seq"] for r in got)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spaced_against_walk(spark, seed):
    """One key owns most times, chunks are shorter and longer than the gap, and times stand on chunk edges."""
    rng = random.Random(seed)
    gap, chunk = rng.choice([(60, 50), (60, 60), (7, 100), (250, 40), (1, 10)])
    rows = [(rng.choice(["hot"] * 5 + ["b", "c", None]), rng.choice([rng.randrange(4000), rng.randrange(40) * chunk])) for _ in range(900)]
    df = spark.createDataFrame([(k, 7, t, "x") for k, t in rows], "name string, pid int, us bigint, chunk_name string").repartition(6)
    want = set()
    for key in {k for k, _ in rows}:
        last = None
        for t in sorted({t for k, t in rows if k == key}):
            if last is None or t - last >= gap:
                last = t
                want.add((key, 7, t))
    got = scan.spaced(df, ["name", "pid"], gap, chunk).where("name IS NOT NULL").collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == {w for w in want if w[0] is not None}


def test_kill_again_after_flight(make_events):
    """A pid that offends again after the kill's time in flight is planned again, sooner it is not."""
    from hostwarden.config import ResourceGuardConfig
    from hostwarden.sources import sinks

    events = make_events([{"source": "resource", "kind": "cpu_abuse", "pid": pid, "name": "w", "at": at, "seq": k} for k, (pid, at) in enumerate([(1, 0), (1, 3), (1, 4.9), (1, 5), (1, 9), (1, 10.5), (2, 1), (2, 1), (1, 4000)])])
    plan = sinks.response_plan(events, ResourceGuardConfig(action="kill"))
    assert sorted(r["seq"] for r in plan.collect()) == [0, 3, 5, 6, 8]
    slow = sinks.response_plan(events, ResourceGuardConfig(action="kill", kill_in_flight_sec=60))
    assert sorted(r["seq"] for r in slow.collect()) == [0, 6, 8]
