"""Features, forest, drift and intel."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hostwarden.config import AnomalyConfig
from hostwarden.operators import anomaly_features as A, drift as D, isolation_forest as IF, threat_intel as I
from tests.conftest import SEC, T0


def test_six_connections(make_events):
    events = make_events([{"source": "network", "pid": 100, "remote_addr": "1.2.3.4", "remote_port": 443, "at": i} for i in range(6)])
    row = A.extract(events).orderBy(F.desc("seq")).first()
    assert [row[c] for c in A.FEATURES] == [1.2, 1.0, 1.0, 1.0, 0.0, 0.0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_features_against_loop(make_events, seed):
    rng = random.Random(seed)
    rows, clock = [], 0
    for n in range(500):
        clock += rng.choice([0, 1, 5, 40, 150, 299, 300, 301]) if rng.random() < 0.4 else rng.choice([0, 1, 2])
        rows.append({
            "seq": n, "at": clock, "pid": rng.choice([1, 1, 1, 2, None]), "source": rng.choice(["network"] * 4 + ["process", "filesystem", "resource"]),
            "remote_addr": rng.choice([None, "a", "b", "c"]), "remote_port": rng.choice([None, 1, 2]),
        })
    got = {r["seq"]: [r[c] for c in A.FEATURES] for r in A.extract(make_events(rows)).collect()}
    pids, procs, files = {}, [], []
    for r in rows:
        now = r["at"]
        procs, files = [t for t in procs if t > now - 300], [t for t in files if t > now - 300]
        for p in list(pids):
            pids[p]["t"] = [t for t in pids[p]["t"] if t > now - 300]
            if not pids[p]["t"]:
                del pids[p]
        pid = r["pid"] or 0
        m = pids.get(pid, {"n": 0, "ips": set(), "ports": set(), "t": []})
        if r["source"] == "process":
            procs.append(now)
        elif r["source"] == "filesystem":
            files.append(now)
        elif r["source"] == "network":
            pids[pid] = m
            m["n"] += 1
            m["t"].append(now)
            if r["remote_addr"] is not None:
                m["ips"].add(r["remote_addr"])
            if r["remote_port"] is not None:
                m["ports"].add(r["remote_port"])
        gap = (m["t"][-1] - m["t"][0]) / (len(m["t"]) - 1) if len(m["t"]) > 1 else 0.0
        want = [m["n"] / 5, len(m["ips"]), len(m["ports"]), gap, len(procs) / 5, len(files) / 5]
        assert got[r["seq"]] == pytest.approx(want), r


@pytest.fixture(scope="module")
def normal_points(spark):
    rng = np.random.default_rng(7)
    data = [("h", i, float(x), float(y)) for i, (x, y) in enumerate(rng.standard_normal((500, 2)))]
    return spark.createDataFrame(data, "host_id string, seq bigint, x double, y double")


def test_forest_separates_outliers(spark, normal_points):
    model = IF.fit(normal_points, features=("x", "y"))
    probe = spark.createDataFrame([("h", 1, 0.0, 0.0), ("h", 2, 100.0, 100.0)], "host_id string, seq bigint, x double, y double")
    got = {r["seq"]: r["anomaly_score"] for r in IF.score(probe, model, features=("x", "y")).collect()}
    assert got[1] < 0.5 and got[2] > 0.7
    sizes = model.where("attr = -1").groupBy("tree_id").agg(F.sum("size").alias("n"), F.max("depth").alias("d")).collect()
    assert len(sizes) == 100 and all(r["n"] == 256 and r["d"] <= 8 for r in sizes)


def test_forest_edges(spark):
    ddl = "host_id string, seq bigint, x double"
    few = spark.createDataFrame([("h", i, 1.0) for i in range(5)], ddl)
    assert IF.fit(few, features=("x",)) is None
    assert IF.score(few, None, features=("x",)).first()["anomaly_score"] == 0.0
    same = spark.createDataFrame([("h", i, 1.0) for i in range(100)], ddl)
    model = IF.fit(same, AnomalyConfig(num_trees=10), ("x",))
    assert model.select("tree_id").distinct().count() == 10
    assert 0 <= IF.score(same, model, features=("x",)).first()["anomaly_score"] <= 1


def test_score_on_a_given_tree(spark):
    nodes = [(0, 0, 0, 5.0, 1, 2, 4, 0), (0, 1, -1, 0.0, -1, -1, 1, 1), (0, 2, -1, 0.0, -1, -1, 3, 1)]
    model = spark.createDataFrame(nodes, "tree_id int, node_id int, attr int, split double, left int, right int, size bigint, depth int")
    rows = spark.createDataFrame([("h", 1, 4.9), ("h", 2, 5.0)], "host_id string, seq bigint, x double")
    got = {r["seq"]: r["anomaly_score"] for r in IF.score(rows, model, AnomalyConfig(sample_size=4), ("x",)).collect()}
    c = IF.path_constant
    assert got == pytest.approx({1: 2 ** (-1 / c(4)), 2: 2 ** (-(1 + c(3)) / c(4))})


def plain_samples(rows, cfg):
    """Every draw of every tree, sorted."""
    out = set()
    for tree in range(cfg.num_trees):
        drawn = []
        for row in rows:
            h = hashlib.md5(f"{cfg.seed}:{row[0]}:{row[1]}".encode()).hexdigest()
            drawn.append(((int(h[:15], 16) + tree * int(h[16:31], 16)) % (1 << 60), row))
        out |= {(tree, draw, *row) for draw, row in sorted(drawn)[: cfg.sample_size]}
    return out


@pytest.mark.parametrize("n, size", [(20_000, 64), (300, 256), (100, 256), (0, 8)])
def test_samples_are_the_least_draws_whatever_the_layout(spark, n, size):
    """Also where a task's batches are smaller or larger than a sample, and where one host owns nearly all rows."""
    cfg = AnomalyConfig(num_trees=4, sample_size=size)
    rows = [("h" if i % 100 else f"k{i % 7}", i, float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "host_id string, seq bigint, x double")
    want = plain_samples(rows, cfg)
    for parts in (1, 3, 40):
        assert set(map(tuple, IF.samples(df.repartition(parts), cfg, ("x",)).collect())) == want
    assert len(want) == 4 * min(n, size)


def test_samples_of_trees_differ(spark):
    rows = spark.range(5000).select(F.lit("h").alias("host_id"), F.col("id").alias("seq"), F.col("id").cast("double").alias("x"))
    per_tree = IF.samples(rows, AnomalyConfig(num_trees=50, sample_size=100), ("x",)).groupBy("tree_id").agg(F.collect_set("seq").alias("s")).collect()
    sets = [set(r["s"]) for r in per_tree]
    shared = [len(a & b) for i, a in enumerate(sets) for b in sets[:i]]
    # 100 of 5000 rows: two independent samples share two rows on average.
    assert 1.5 < sum(shared) / len(shared) < 2.5 and max(shared) < 15
    assert len(set().union(*sets)) > 3000


def test_tree_numbering_and_packing():
    """Children are 2 i + 1 and 2 i + 2; a model numbered in another way scores the same."""
    rng = np.random.default_rng(3)
    data = rng.normal(size=(200, 3))
    trees = [IF.build_tree(t, data, 8, 42) for t in range(5)]
    for tree in trees:
        inner = tree[tree["attr"] >= 0]
        assert (inner["left"] == 2 * inner["node_id"] + 1).all() and (inner["right"] == inner["left"] + 1).all()
        assert set(inner["left"]) | set(inner["right"]) == set(tree["node_id"]) - {0}
        assert tree[tree["attr"] < 0]["size"].sum() == 200 and tree["depth"].max() <= 8
    model = pd.concat(trees)
    dense = []
    for tree in trees:
        order = {n: k for k, n in enumerate(sorted(tree["node_id"]))} | {-1: -1}
        dense.append(tree.assign(**{c: tree[c].map(order) for c in ("node_id", "left", "right")}))

    def walk(point, tree):
        nodes = {n: row for n, row in zip(tree["node_id"], tree.itertuples())}
        at = nodes[0]
        while at.attr >= 0:
            at = nodes[at.left if point[at.attr] < at.split else at.right]
        return at.depth + IF.path_constant(at.size)

    want = [np.mean([walk(p, tree) for tree in trees]) for p in data]
    for packed in (IF._pack(model), IF._pack(pd.concat(dense).sample(frac=1, random_state=1))):
        assert np.allclose(IF.path_rows(data, packed), want)


def test_drift(spark):
    def table(values, start=0):
        return spark.createDataFrame([("h", start + i, T0 + (start + i) * SEC, v) for i, v in enumerate(values)], "host_id string, seq bigint, us bigint, anomaly_score double").withColumn("ts", F.timestamp_micros("us"))

    base = D.baseline(table([0.3, 0.31, 0.32, 0.33, 0.34]))
    assert D.test(table([0.9] * 50, 10), base).first()["drifted"] is True
    assert D.test(table([0.32] * 50, 10), base).first()["drifted"] is False
    assert D.test(table([0.9]).where("seq < 0"), base).first()["drifted"] is False
    assert D.test(table([0.9] * 5), D.baseline(table([0.5] * 9))).first()["drift_sigma"] == 0.0


def test_retrain_decisions_against_loop(spark):
    """Windows and baselines with plain lists: after a decision the window is empty and the last scores are the baseline."""
    rng = random.Random(6)
    cfg = AnomalyConfig(drift_window_size=20, max_buffer=50, drift_threshold=1.5)
    scores, labels, clock = [], [], 0
    for k in range(600):
        clock += rng.choice([1, 20, 20, 400])
        scores.append((clock, 0.3 + 0.02 * rng.random() + (0.2 if k % 200 > 120 else 0.0)))
        if 200 < k < 500:
            labels.append((clock, k % 2 == 0))
    table = spark.createDataFrame([("h", k, T0 + t * SEC, v) for k, (t, v) in enumerate(scores)], "host_id string, seq bigint, us bigint, anomaly_score double").withColumn("ts", F.timestamp_micros("us"))
    marks = spark.createDataFrame([(T0 + t * SEC, fp) for t, fp in labels], "us bigint, false_positive boolean").withColumn("ts", F.timestamp_micros("us"))
    start = table.where("seq < 50")
    got = D.retrain_decisions(D.checks(table, marks, cfg), D.baseline(start), cfg).orderBy("check_ts").collect()

    def stats(values):
        mean = sum(values) / len(values)
        return mean, (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5

    (mean, std), since, last, want = stats([v for _, v in scores[:50]]), 0, None, []
    grid = 300
    begin = T0 // SEC
    for number in range((begin + scores[0][0]) // grid + 1, (begin + scores[-1][0]) // grid + 2):
        seen = [v for t, v in scores if begin + t < number * grid]
        window = seen[max(since, len(seen) - 20):]
        sigma = abs(sum(window) / len(window) - mean) / std if window and std else 0.0
        fps = [fp for t, fp in labels if begin + t < number * grid]
        due = len(fps) >= 10 and sum(fps) / len(fps) > 0.3 and (last is None or number - last > 3)
        last = number if due else last
        if sigma > 1.5 or due:
            want.append((number * grid, round(sigma, 6), sigma > 1.5, due))
            (mean, std), since = stats(seen[-50:]), len(seen)
    assert [(int(r["check_ts"].timestamp()), round(r["drift_sigma"], 6), r["drifted"], r["fp_due"]) for r in got] == want
    assert {(d, f) for _, _, d, f in want} >= {(True, False), (False, True)}
    # Silent after a decision until the scores move again.
    drifts = [n for n, _, d, _ in want if d]
    assert len(drifts) < 20


def test_narrowest_range_and_ipv6(spark):
    ranges = spark.createDataFrame(
        [("10.0.0.0", "10.255.255.255", "A"), ("10.1.0.0", "10.1.0.63", "B"), ("2001:db8::", "2001:db8::ffff", "RU"), ("0.0.0.0", "255.255.255.255", "D")],
        "ip_from string, ip_to string, country_code string",
    ).withColumns({"country": F.lit(""), "city": F.lit("")})
    ips = spark.createDataFrame([("10.1.0.7",), ("10.1.0.64",), ("2001:db8::12",), ("9.9.9.9",), ("::1",), ("bad",)], "ip string")
    got = {r["ip"]: (r["country_code"], r["high_risk_country"]) for r in I.geo_lookup(ips, ranges).collect()}
    assert got == {"10.1.0.7": ("B", False), "10.1.0.64": ("A", False), "2001:db8::12": ("RU", True), "9.9.9.9": ("D", False)}


@pytest.mark.parametrize("rows_each", [50_000, 7])
def test_narrowest_of_overlapping_ranges(spark, monkeypatch, rows_each):
    """Nested, crossing, equal and touching ranges, most of them over one block; one part and many give the same."""
    monkeypatch.setattr(I, "_SWEEP_ROWS", rows_each)
    rng = random.Random(8)
    text = lambda n: ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    base = 10 << 24
    spans = [(0, (1 << 32) - 1), (base, base + 99_999), (base + 5, base + 5), (base + 6, base + 6)]
    for _ in range(120):
        lo = base + rng.randrange(3000) * rng.choice([1, 1, 1, 20])
        spans.append((lo, lo + rng.choice([0, 1, 5, 40, 400, 3000])))
    spans += spans[5:9]
    ranges = spark.createDataFrame([(text(lo), text(hi), f"C{k % 50}", "", f"city {k}") for k, (lo, hi) in enumerate(spans)] + [("9.9.9.9", "9.9.9.1", "X", "", ""), ("bad", "9.9.9.9", "X", "", "")], "ip_from string, ip_to string, country_code string, country string, city string")
    points = {p for _ in range(250) for k in (0, 1) for d in (-1, 0, 1) if 0 <= (p := rng.choice(spans)[k] + d) < 1 << 32} | {base + k for k in range(300)}
    found = {r["ip"]: (r["country_code"], r["city"]) for r in I.geo_lookup(spark.createDataFrame([(text(p),) for p in points] + [("none",), ("::2",)], "ip string"), ranges).collect()}
    want = {}
    for p in points:
        over = [(hi - lo, -lo, f"C{k % 50}", "", f"city {k}") for k, (lo, hi) in enumerate(spans) if lo <= p <= hi]
        want[text(p)] = min(over)[2::2]
    assert found == want
    pieces = [(r["lo"], r["hi"]) for r in I.segments(ranges).orderBy("lo").collect()]
    assert all(a[1] < b[0] for a, b in zip(pieces, pieces[1:])) and len(pieces) <= 2 * len(spans) + 40


def test_enrichment_scores(spark, make_events):
    bad = "ab" * 32
    events = make_events([
        {"source": "network", "remote_addr": "1.1.1.1"}, {"source": "network", "remote_addr": "1.1.1.1", "at": 100}, {"source": "filesystem", "new_hash": bad},
        {"source": "filesystem", "new_hash": "cd" * 32}, {"source": "filesystem", "new_hash": "short"}, {},
    ])
    abuse = spark.createDataFrame([("1.1.1.1", 51.0, "US", 1, False, "i", T0 + 50 * SEC)], "ip string, abuse_score double, country string, total_reports int, is_whitelisted boolean, isp string, e bigint")
    abuse = abuse.withColumn("expires", F.timestamp_micros("e")).drop("e")
    malware = spark.createDataFrame([(bad, "f", ["t"], "elf", "")], "sha256 string, family string, tags array<string>, file_type string, first_seen string")
    rows = I.enrich(events, abuse=abuse, malware=malware).orderBy("seq").collect()
    assert [r["intel_bonus"] for r in rows] == [20.0, 0.0, 80.0, 0.0, 0.0, 0.0]
    assert [None if r["threat_intel"]["malware_check"] is None else r["threat_intel"]["malware_check"]["known_malware"] for r in rows] == [None, None, True, False, None, None]
    assert rows[1]["threat_intel"]["abuseipdb"] is None


def test_wide_events_are_not_shuffled_for_a_few_answers(spark, make_events):
    """Answers and hashes are written tables, small ones go to the events; addresses may come from elsewhere."""
    events = make_events([{"source": "network", "remote_addr": f"1.2.3.{n % 4}", "new_hash": "a" * 64} for n in range(20)])
    seen = events.groupBy(F.col("remote_addr").alias("ip")).agg(F.count(F.lit(1)).cast("double").alias("abuse_score"), F.max("ts").alias("expires"))
    abuse = seen.selectExpr("ip", "abuse_score * 20 as abuse_score", "'US' as country", "1 as total_reports", "false as is_whitelisted", "'i' as isp", "expires + interval 1 minute as expires")
    malware = events.groupBy(F.col("new_hash").alias("sha256")).agg(F.lit("f").alias("family"), F.array(F.lit("t")).alias("tags"), F.lit("elf").alias("file_type"), F.lit("d").alias("first_seen"))
    for more in ({}, {"addresses": spark.createDataFrame([(f"1.2.3.{n}",) for n in range(9)], "ip string")}):
        out = I.enrich(events.repartition(4), abuse, malware=malware, **more)
        assert {r["intel_bonus"] for r in out.collect()} == {100.0}
        assert "hashpartitioning(_" not in out._jdf.queryExecution().executedPlan().toString()


def test_draws_rank_a_block_only_until_trees_have_limits(monkeypatch):
    """Past the first rows of a task a block is compared with limits; ranking every block cost more than all else."""
    import pyarrow as pa

    monkeypatch.setattr(IF.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))
    calls, real = [], np.partition
    monkeypatch.setattr(IF.np, "partition", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    rng, n, trees, size = np.random.default_rng(5), 120_000, 4, 16
    a, b = (rng.integers(0, 1 << 60, n) for _ in "ab")
    rows = pa.table({"_a": a, "_b": b, "seq": np.arange(n)})
    out = pa.Table.from_batches(list(IF._draws(trees, size, ("seq",))(iter(rows.to_batches(10_000)))))
    for t in range(trees):
        draw = (a.astype(object) + t * b.astype(object)) % (1 << 60)
        assert out.filter(pa.array(out["tree_id"].to_numpy() == t))["seq"].to_pylist() == sorted(range(n), key=lambda k: draw[k])[:size]
    assert len(calls) < 15
