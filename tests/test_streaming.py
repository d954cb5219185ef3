"""Streams over several micro-batches give the batch results."""

import random
import time

import pytest
from pyspark.sql import functions as F

from hostwarden.operators import anomaly_features as A, correlation as C, network_monitor as N, risk_state as E
from hostwarden.operators.process_monitor import appeared as batch_appeared, scans
from hostwarden.schema import FEATURES
from hostwarden.streaming import jobs, operators as S
from hostwarden.streaming.stateful import late, observed, used
from tests.conftest import SEC, T0


def in_batches(spark, df, folder, n, by="ts"):
    """Write ``df`` as n files in time order, read as one file per micro-batch."""
    bounds = df.agg(F.min(F.unix_micros(by)).alias("a"), F.max(F.unix_micros(by)).alias("b")).first()
    width = (bounds["b"] - bounds["a"]) // n + 1
    for i in range(n):
        part = df.where(F.floor((F.unix_micros(by) - bounds["a"]) / width) == i)
        part.coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """State stores are opened once a partition and batch; two are enough for these rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def drain(stream, tmp_path):
    jobs.start_parquet(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


@pytest.fixture(scope="module")
def random_events(make_events):
    rng = random.Random(3)
    rows, clock = [], 0
    for n in range(400):
        clock += rng.choice([0, 1, 2, 5, 30, 90])
        source = rng.choice(["process", "network", "filesystem"])
        rows.append({
            "seq": n, "at": clock, "pid": rng.randint(1, 3), "source": source, "entity_id": f"{source}{rng.randint(0, 4)}", "exe": rng.choice(["/tmp/a", "/b"]),
            "remote_port": rng.choice([22, 4444, 80]), "remote_addr": f"9.9.9.{rng.randint(0, 1)}", "path": "/etc/crontab",
        })
    # network entities are named after their address
    for r in rows:
        if r["source"] == "network":
            r["entity_id"] = f"net:{r['remote_addr']}:{r['remote_port']}"
        else:
            r["remote_addr"] = None
    return make_events(rows).withColumn("score", (F.col("seq") % 7 * 5 + 5).cast("double"))


def test_correlation_equals_batch(spark, random_events, tmp_path):
    out = drain(S.correlate(in_batches(spark, random_events, tmp_path / "in", 4)), tmp_path)
    cols = ["seq", "source_count", "related_count", "patterns", "pattern_bonus"]
    assert sorted(map(tuple, map(lambda r: (r[0], r[1], r[2], tuple(r[3]), r[4]), out.select(*cols).collect()))) == sorted(
        (r[0], r[1], r[2], tuple(r[3]), r[4]) for r in C.correlate(random_events).select(*cols).collect()
    )


def test_risk_state_equals_batch(spark, random_events, tmp_path):
    out = drain(S.risk_transitions(in_batches(spark, random_events, tmp_path / "in", 4)), tmp_path).collect()
    newest = random_events.agg(F.max(F.unix_micros("ts"))).first()[0]
    until = newest // 1000 * 1000 - 60 * SEC
    tracked = E.track(random_events)
    want = E.event_transitions(tracked).unionByName(E.decay_transitions(tracked, until)).collect()
    cols = ("entity_id", "us", "from_state", "to_state", "score", "cause")
    assert sorted(tuple(r[c] for c in cols) for r in out) == sorted(tuple(r[c] for c in cols) for r in want)


def test_late_rows_are_dropped(spark, make_events, tmp_path):
    first = make_events([{"at": 0}, {"at": 1000}])
    middle = make_events([{"at": 1100, "seq": 8}])  # rows are judged by the watermark of the batch before
    late = make_events([{"at": 5, "seq": 9}, {"at": 2000, "seq": 10}])
    folder = str(tmp_path / "in")
    for part in (first, middle, late):
        part.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = drain(S.windowed_kinds(stream), tmp_path).orderBy("window_start").collect()
    assert [r["n"] for r in rows] == [1, 2]


def test_model_store_versions(spark, tmp_path):
    from hostwarden.operators import isolation_forest as IF

    rows = spark.range(50).select(F.lit("h").alias("host_id"), F.col("id").alias("seq"), F.col("id").cast("double").alias("x"))
    store = jobs.ModelStore(spark, str(tmp_path / "models"))
    assert store.current() is None
    model = IF.fit(rows, features=("x",))
    assert [store.publish(model), store.publish(model)] == [0, 1]
    assert store.current().select("tree_id").distinct().count() == 100


def test_retrain_cycle(spark, make_events, tmp_path):
    """Small first batches wait, the baseline is that of the training rows, the window is empty after a retrain, a replay changes nothing."""
    from hostwarden.config import AnomalyConfig
    from hostwarden.operators import drift as D, isolation_forest as IF

    def rows(start, n, shift):
        return spark.range(start, start + n, numPartitions=2).select(
            F.lit("h").alias("host_id"), F.col("id").alias("seq"), F.timestamp_micros(F.lit(T0) + F.col("id") * SEC).alias("ts"),
            *[((F.col("id") * (i + 3) * 7919 % 101) / 101 + shift).alias(c) for i, c in enumerate(FEATURES)],
        )

    cfg = AnomalyConfig(num_trees=20, sample_size=64, max_buffer=250, drift_window_size=100)
    labels = spark.createDataFrame([("r", k % 2 == 0) for k in range(20)], "rule_name string, false_positive boolean")
    wanted = []

    def run(folder, load=None, replay=False):
        store = jobs.ModelStore(spark, str(folder / "models"))
        handle = jobs.drift_handler(store, str(folder / "scores"), cfg, load)
        for batch_id, batch in enumerate([rows(0, 4, 0), rows(4, 300, 0), rows(304, 300, 0), rows(604, 300, 50), rows(904, 300, 50), rows(1204, 300, 50), rows(1504, 30, 50)]):
            for _ in range(2 if replay else 1):
                handle(batch, batch_id)
        return store.commits(), spark.read.parquet(str(folder / "scores")).select("seq", "version", "anomaly_score").orderBy("seq").collect()

    commits, scores = run(tmp_path / "a")
    assert [(c["version"], c["batch_id"], c["n"]) for c in commits] == [(0, 1, 304), (1, 3, 250)]
    assert commits[1]["reason"].startswith("score mean shifted")
    assert [sorted({r["version"] for r in scores if lo <= r["seq"] < hi}) for lo, hi in ((0, 304), (304, 904), (904, 1534))] == [[-1], [0], [1]]
    for training, commit in ((rows(0, 4, 0).unionByName(rows(4, 300, 0)), commits[0]), (rows(654, 250, 50), commits[1])):
        want = D.baseline(IF.score(training, IF.fit(training, cfg), cfg)).first()
        assert (commit["n"], commit["base_mean"], commit["base_std"]) == pytest.approx((want["n"], want["base_mean"], want["base_std"]))
    again = run(tmp_path / "b", replay=True)
    assert [tuple(c) for c in again[0]] == [tuple(c) for c in commits] and again[1] == scores
    with_labels = run(tmp_path / "c", lambda: labels)[0]
    assert [c["batch_id"] for c in with_labels if "FP rate 50%" in c["reason"]] == [2, 6]


def parts(spark, frames, folder):
    """One micro-batch a frame."""
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def state_rows(stream, tmp_path):
    """Rows of state after every micro-batch, largest operator first seen, and what was written."""
    query = jobs.start_parquet(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination()
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress]


CONNECTIONS = "host_id string, scan_ts timestamp, seq bigint, pid int, status string, local_port int, remote_addr string, remote_port int"


@pytest.fixture(scope="module")
def snapshots(spark):
    """Scans of two hosts: connections that come and go, of one pid above all, with files and samples in the same rows."""
    rng = random.Random(11)
    rows, seq = [], 0
    for scan in range(40):
        at = T0 + scan * rng.choice([20, 20, 35]) * SEC if scan < 3 else T0 + scan * 20 * SEC
        for host in ("a", "b"):
            if host == "b" and scan % 7 == 3:
                continue
            for _ in range(rng.randrange(1, 14) if scan % 10 else 60):
                seq += 1
                pid = 1 if rng.random() < 0.6 else rng.randrange(2, 9)
                rows.append((host, at, seq, pid, rng.choice(["ESTABLISHED"] * 4 + ["LISTEN"]), rng.randrange(3), rng.choice(["9.9.9.9", "8.8.8.8", "127.0.0.1", None]), rng.choice([80, 443, 4444, *range(1000, 1030)])))
    df = spark.createDataFrame(rows, CONNECTIONS.replace("timestamp", "bigint")).withColumn("scan_ts", F.timestamp_micros("scan_ts"))
    return df


def test_scans_equal_batch_over_hosts(spark, snapshots, tmp_path):
    """Buckets see every scan of their host, also one in which none of their items occurs."""
    out = drain(S.appeared(in_batches(spark, snapshots, tmp_path / "in", 5, "scan_ts"), ["pid"], buckets=5), tmp_path)
    want = batch_appeared(snapshots, ["pid"], scans(snapshots)).select("host_id", F.unix_micros("scan_ts"), F.col("pid").cast("string")).distinct()
    assert sorted(map(tuple, out.select("host_id", "us", "item").collect())) == sorted(map(tuple, want.collect()))


def test_network_equals_batch_over_hosts(spark, snapshots, tmp_path):
    out = drain(S.network_verdicts(in_batches(spark, snapshots, tmp_path / "in", 5, "scan_ts"), buckets=3), tmp_path).collect()
    want = N.events(snapshots).collect()
    assert sorted((r["host_id"], r["seq"], r["kind"]) for r in out) == sorted((r["host_id"], r["seq"], r["kind"]) for r in want)
    assert {r["kind"] for r in out} == {"port_scan", "suspicious_port", "high_conn_rate", "new_outbound"}


def test_features_equal_batch(spark, random_events, tmp_path):
    got = drain(S.features(in_batches(spark, random_events, tmp_path / "in", 5)), tmp_path).collect()
    want = A.extract(random_events).collect()
    key = lambda r: (r["seq"], *[round(r[c], 9) for c in FEATURES])
    assert sorted(map(key, got)) == sorted(map(key, want))


def _samples(df):
    return df.select("host_id", F.col("ts").alias("scan_ts"), "seq", "pid", F.col("entity_id").alias("name"), F.col("entity_id").alias("path"), F.col("seq").cast("double").alias("cpu_pct"),
                     F.col("message").alias("hash"), F.col("seq").alias("size"), F.lit("ESTABLISHED").alias("status"), F.lit(1).alias("local_port"), F.lit("9.9.9.9").alias("remote_addr"), (F.col("seq") % 30).cast("int").alias("remote_port"))


def _timed(df):
    return df.select("host_id", "pid", F.lit("k").alias("kind"), F.lit(1).alias("life"), F.unix_micros("ts").alias("us"), "seq")


ENDING = {
    "appeared": lambda s: S.appeared(_samples(s), ["pid"], buckets=4, forget_sec=300, keep_late=True),
    "modified_files": lambda s: S.modified_files(_samples(s), forget_sec=300, keep_late=True),
    "sliding_count": lambda s: S.sliding_count(_timed(s), ["host_id", "pid"], 60, keep_late=True),
    "network_verdicts": lambda s: S.network_verdicts(_samples(s), buckets=4, forget_sec=300, keep_late=True),
    "correlate": lambda s: S.correlate(s, keep_late=True),
    "cooldown": lambda s: S.cooldown(_timed(s), keep_late=True),
    "cpu_baseline": lambda s: S.cpu_baseline(_samples(s), forget_sec=300, keep_late=True),
    "features": lambda s: S.features(s, keep_late=True),
    "risk_transitions": lambda s: S.risk_transitions(s.withColumn("score", F.lit(20.0)), keep_late=True),
}


@pytest.mark.parametrize("name", list(ENDING))
def test_state_ends_and_late_rows_stay(spark, make_events, tmp_path, name):
    """State grows with the keys in use and falls to that of the last key; a row far behind is returned as late."""
    early = make_events([{"at": k % 50, "seq": k, "pid": 1 + k % 25, "source": ["network", "process", "filesystem"][k % 3], "entity_id": f"e{k % 25}", "remote_addr": f"9.9.9.{k % 5}", "remote_port": k % 7} for k in range(100)])
    last = make_events([{"at": 100_000, "seq": 500, "pid": 900, "source": "network", "entity_id": "z", "remote_addr": "1.1.1.1", "remote_port": 1}])
    behind = make_events([{"at": 10, "seq": 600, "pid": 3, "source": "process", "entity_id": "e3"}, {"at": 100_001, "seq": 601, "pid": 900, "source": "network", "entity_id": "z", "remote_addr": "1.1.1.1", "remote_port": 2}])
    counts = state_rows(ENDING[name](parts(spark, [early, last, behind], tmp_path / "in")), tmp_path)
    # What one key may hold: its values, its entries and its timer, twice for two operators; a host's clock once a bucket.
    assert max(counts) >= 25 or name in ("appeared", "network_verdicts") and max(counts) >= 8
    assert counts[-1] <= 20 and counts[-1] < max(counts)
    out = spark.read.parquet(str(tmp_path / "out"))
    if "seq" in out.columns:
        assert [r["seq"] for r in late(out).collect()] == [600]
    else:
        assert late(out).count() == 1
    assert used(out).where(F.col("us") == T0 + 10 * SEC).count() >= 0


def test_late_and_used_rows_are_all_rows(spark, make_events, tmp_path):
    """By the counts that the query observes itself, and by the two tables."""
    frames = [make_events([{"at": b * 1000 + k - (3000 if b == 3 and k < 5 else 0), "seq": b * 50 + k, "pid": k % 4 + 1} for k in range(50)]) for b in range(4)]
    stream = observed(S.correlate(parts(spark, frames, tmp_path / "in"), keep_late=True), "rows")
    query = jobs.start_batches(stream, jobs.write_with_late(str(tmp_path / "used"), str(tmp_path / "late")), str(tmp_path / "ckpt"))
    query.awaitTermination()
    seen = [p["observedMetrics"]["rows"] for p in query.recentProgress if "rows" in p["observedMetrics"]]
    assert (sum(r["used"] for r in seen), sum(r["late"] for r in seen)) == (195, 5)
    assert spark.read.parquet(str(tmp_path / "used")).count() == 195
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "late")).collect()) == list(range(150, 155))


def test_live_entities_while_state_decays(spark, make_events, tmp_path):
    """The state store read as a table at several times equals the batch snapshot of the same events."""
    from hostwarden.plans import live

    rng = random.Random(5)
    events = make_events([{"seq": k, "at": rng.randrange(900), "entity_id": f"e{rng.randrange(12)}", "source": "process"} for k in range(120)]).withColumn("score", (F.col("seq") % 9 * 4).cast("double"))
    stream = in_batches(spark, events, tmp_path / "in", 4)
    jobs.start_parquet(S.track_risk(stream), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    tracked = E.track(events)
    for later in (900, 1000, 1333, 2000, 4000):
        at = T0 + later * SEC
        rows = [sorted(tuple(r) for r in df.collect()) for df in (live.entities(spark, str(tmp_path / "ckpt"), at), E.snapshot(tracked, at))]
        assert [(r[:3], *r[4:]) for r in rows[0]] == [(r[:3], *r[4:]) for r in rows[1]]
        assert [r[3] for r in rows[0]] == pytest.approx([r[3] for r in rows[1]])


def test_intel_cache_job(spark, make_events, tmp_path):
    """New addresses are looked up once, again after the time to live, and a repeated batch changes nothing."""
    from hostwarden.config import ThreatIntelConfig
    from hostwarden.plans.scoring import Intel

    abuse = spark.createDataFrame([("1.1.1.1", 60.0, "US", 1, False, "i", T0 + 10**12)], "ip string, abuse_score double, country string, total_reports int, is_whitelisted boolean, isp string, e bigint")
    intel = Intel(abuse=abuse.withColumn("expires", F.timestamp_micros("e")).drop("e"))
    cache = jobs.IntelCache(spark, str(tmp_path / "cache"))
    handle = jobs.fill_intel_cache(cache, lambda: intel, ThreatIntelConfig(cache_ttl_minutes=10))
    first = make_events([{"remote_addr": "1.1.1.1"}, {"remote_addr": "2.2.2.2", "at": 5}, {"at": 6}])
    soon, after = make_events([{"remote_addr": "1.1.1.1", "at": 300}, {"remote_addr": "3.3.3.3", "at": 300}]), make_events([{"remote_addr": "1.1.1.1", "at": 700}])
    assert cache.table() is None
    for batch_id, batch in ((0, first), (1, soon), (1, soon), (2, after), (2, after)):
        handle(batch, batch_id)
    looked_up = sorted((r["ip"], r["batch_id"]) for r in spark.read.parquet(str(tmp_path / "cache")).collect())
    assert looked_up == [("1.1.1.1", 0), ("1.1.1.1", 2), ("2.2.2.2", 0), ("3.3.3.3", 1)]
    answers = {r["ip"]: r["abuseipdb"] for r in cache.resolved().collect()}
    assert answers["1.1.1.1"]["abuse_score"] == 60.0 and answers["2.2.2.2"] is None


def test_keys_share_groups(spark, make_events, tmp_path, monkeypatch):
    """Many entities of a host are few groups of the state store; one of them has more rows than are taken at a time."""
    from hostwarden.streaming import stateful

    monkeypatch.setattr(stateful, "CROWDS", 4)
    rng = random.Random(9)
    events = make_events([{"seq": k, "at": rng.randrange(3000), "entity_id": "hot" if k % 2 else f"e{rng.randrange(700)}", "source": "process"} for k in range(24_000)])
    events = events.withColumn("score", (F.col("seq") % 5).cast("double"))
    out = drain(S.risk_transitions(in_batches(spark, events, tmp_path / "in", 2)), tmp_path)
    tracked = E.track(events)
    until = events.agg(F.max(F.unix_micros("ts"))).first()[0] // 1000 * 1000 - 60 * SEC
    want = E.event_transitions(tracked).unionByName(E.decay_transitions(tracked, until))
    cols = ("entity_id", "us", "from_state", "to_state", "score", "cause")
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    held = spark.read.format("statestore").option("stateVarName", "memories").load(str(tmp_path / "ckpt"))
    assert held.count() > 300 and held.select("key").distinct().count() <= 4


def test_a_slice_is_counted_in_bounded_frames():
    """A slice of many rows leaves in frames of bounded size, with the counts of a plain loop; late rows have none."""
    import pandas as pd
    import pyarrow as pa

    from hostwarden.streaming.stateful import CHUNK

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Handle:
        def getValueState(self, name, ddl):
            return Value()

        def registerTimer(self, at):
            pass

        def deleteTimer(self, at):
            pass

        def getCurrentWatermarkInMs(self):
            return 1

    rng = random.Random(4)
    rows = [(rng.randrange(990, 60_000), k, rng.random() < 0.7, 7, rng.choice(["process", "filesystem", "network", None])) for k in range(25_000)]
    columns = pa.schema([("us", pa.int64()), ("seq", pa.int64()), ("own", pa.bool_()), ("pid", pa.int32()), ("source", pa.string())])
    node = S._HostRates(["host_id", "slice"], "host_id string, slice bigint, us bigint, seq bigint, procs bigint, files bigint, pid int, source string, late boolean, ts timestamp", True, 5_000, columns)
    node.init(Handle())
    parts = [pd.DataFrame(rows[k : k + 10_000], columns=columns.names) for k in range(0, len(rows), 10_000)]
    frames = list(node.handleInputRows(("h", 0), iter(parts), Handle()))
    assert len(frames) > 1 and max(map(len, frames)) <= CHUNK
    got = {int(r.seq): (r.procs, r.files, r.late) for f in frames for r in f.astype(object).where(f.notna(), None).itertuples()}
    times, want = {"process": [], "filesystem": []}, {}
    for us, seq, own, _, source in sorted(rows, key=lambda r: r[:2]):
        if us < 1000:
            want |= {seq: (None, None, True)} if own else {}
            continue
        if source in times:
            times[source].append(us)
        if own:
            want[seq] = (*(sum(t > us - 5_000 for t in known[-9_000:]) for known in times.values()), False) if seq % 50 == 0 else None
    assert got.keys() == want.keys()
    assert all(got[k] == w for k, w in want.items() if w is not None)


def test_a_group_is_read_and_written_at_once(spark):
    """What a group asks of the state store does not grow with its keys; its alarm wakes the keys that are due, and the last one clears it."""
    import pandas as pd
    from pyspark.sql import types as T

    from hostwarden.config import Thresholds

    class Store:
        def __init__(self, log, held=None):
            self.log, self.held = log, held

        def __getattr__(self, call):
            self.log.append(call)
            return {
                "exists": lambda: self.held is not None, "get": lambda: iter(self.held) if isinstance(self.held, list) else self.held,
                "put": lambda rows: setattr(self, "held", rows), "update": lambda row: setattr(self, "held", row), "clear": lambda: setattr(self, "held", None),
            }[call]

    class Handle:
        def __init__(self):
            self.log, self.timers, self.now = [], [], 0

        def getListState(self, name, schema):
            return Store(self.log)

        getValueState = getListState

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

        def getCurrentWatermarkInMs(self):
            return self.now

    handle = Handle()
    node = S._Risk(["host_id", "entity_id"], "host_id string, entity_id string, us bigint, seq bigint, from_state int, to_state int, score double, cause string, late boolean", False, Thresholds(), [])
    node.hold([T.StructField("entity_id", T.StringType())])
    node.init(handle)
    rows = pd.DataFrame([("h", f"e{k}" if k else None, 31_000_000 + k, k, 20.0, "process") for k in range(2000)], columns=["host_id", "entity_id", "us", "seq", "x", "source"])
    for seq in (0, 2000):
        found = pd.concat(node.handleInputRows(("h", 0), iter([rows.assign(seq=rows["seq"] + seq)]), handle))
        assert len(found) == 2000 and set(found["to_state"]) == ({1} if seq == 0 else {2})
    assert len(handle.log) < 20 and len(handle.timers) == 1 and len(node.memories.held) == 2000
    handle.now = handle.timers.pop() + 1
    woken = pd.concat(node.handleExpiredTimer(("h", 0), handle, None))
    assert len(woken) == 2000 and set(zip(woken["from_state"], woken["to_state"])) == {(2, 1)} and woken["entity_id"].isna().sum() == 1
    while handle.timers:
        handle.now = handle.timers.pop() + 1
        list(node.handleExpiredTimer(("h", 0), handle, None))
    assert node.memories.held is None and len(handle.log) < 100
