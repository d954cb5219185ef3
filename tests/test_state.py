"""Risk state: scenarios, and a comparison with a tick-by-tick loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hostwarden.config import Thresholds
from hostwarden.operators import risk_state as E
from tests.conftest import SEC, T0

TH = Thresholds()
LABELS = ["CLEAN", "WATCHING", "SUSPICIOUS", "THREAT", "BLOCKED"]


def tracked(make_events, rows):
    df = make_events([{"entity_id": "e", **{k: v for k, v in r.items() if k != "x"}} for r in rows])
    xs = {n: float(r["x"]) for n, r in enumerate(rows)}
    table = df.sparkSession.createDataFrame(list(xs.items()), "seq bigint, score double")
    return E.track(df.join(table, "seq"))


@pytest.mark.parametrize("score, state", [(20, 1), (40, 2), (70, 3), (100, 4), (14.9, 0), (15, 1), (35, 2), (65, 3), (90, 4)])
def test_single_score(make_events, score, state):
    assert tracked(make_events, [{"x": score}]).first()["state"] == state


def test_accumulate_in_one_tick(make_events):
    row = tracked(make_events, [{"x": 20}, {"x": 20, "at": 1}]).orderBy("seq").collect()[1]
    assert (row["score"], row["state"]) == (40.0, 2)


@pytest.mark.parametrize("score, minutes, want", [(50, 1, 45.0), (2, 1, 0.0), (100, 10, 100.0)])
def test_decay(make_events, score, minutes, want):
    snap = E.snapshot(tracked(make_events, [{"x": score}]), T0 + minutes * 60 * SEC).first()
    assert snap["score"] == want


def test_eviction(make_events):
    t = tracked(make_events, [{"x": 1}])
    assert E.snapshot(t, T0 + 600 * SEC).count() == 1
    assert E.snapshot(t, T0 + 630 * SEC).count() == 0


def test_transition_rows(make_events):
    rows = E.transitions(tracked(make_events, [{"x": 20}])).orderBy("us").collect()
    assert [(r["from_label"], r["to_label"], r["cause"]) for r in rows] == [("CLEAN", "WATCHING", "event"), ("WATCHING", "CLEAN", "decay")]
    assert rows[1]["us"] == T0 + 90 * SEC


def loop(rows, until_us):
    """The state machine ticking every 30 s over one entity."""
    line, m, changes, after = 30 * SEC, None, [], []

    def rank(s):
        return 4 if s >= 90 else 3 if s >= 65 else 2 if s >= 35 else 1 if s >= 15 else 0

    def ticks(m, frm, to):
        for t in range(frm // line + 1, to // line + 1):
            if m is None or m["state"] == 4:
                break
            m["score"] = max(0.0, m["score"] - 2.5)
            if rank(m["score"]) != m["state"]:
                changes.append((t * line, m["state"], rank(m["score"]), m["score"], "decay"))
                m["state"] = rank(m["score"])
            if m["score"] == 0 and t * line - m["last"] > 600 * SEC:
                m = None
        return m

    now = None
    for us, x in rows:
        if m is not None:
            m = ticks(m, now, us)
        if m is None:
            m = {"score": 0.0, "state": 0, "count": 0, "first": us}
        m["score"] += x
        m["count"] += 1
        m["last"] = now = us
        if rank(m["score"]) != m["state"]:
            changes.append((us, m["state"], rank(m["score"]), m["score"], "event"))
            m["state"] = rank(m["score"])
        after.append((round(m["score"], 6), m["state"], m["count"], m["first"]))
    end = ticks(m, now, until_us)
    return after, changes, None if end is None else (round(end["score"], 6), end["state"], end["count"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_loop_with_a_hot_entity(spark, seed):
    rng = random.Random(seed)
    data, seq, per = [], 0, {}
    for name in ["hot"] * 12 + [f"e{i}" for i in range(60)]:
        clock = per.get(name, [(T0 + rng.randint(0, 100) * SEC, 0)])[-1][0]
        for _ in range(rng.randint(1, 25)):
            clock += rng.choice([0, 1, 29, 30, 31, 90, 400, 630, 1500]) * SEC + rng.choice([0, 1])
            x = rng.choice([1.0, 2.5, 5.0, 12.5, 20.0]) if name != "hot" else 2.5
            per.setdefault(name, []).append((clock, x))
    for name, rows in per.items():
        for us, x in rows:
            data.append(("h", name, seq, us, x, "process"))
            seq += 1
    until = max(d[3] for d in data) + 300 * SEC
    df = spark.createDataFrame(data, "host_id string, entity_id string, seq bigint, us bigint, score double, source string").withColumn(
        "ts", F.timestamp_micros("us")
    ).drop("us")
    t = E.track(df)
    rows = E.with_incarnation(t).orderBy("seq").collect()
    moves = E.transitions(t, until).collect()
    snap = {r["entity_id"]: (round(r["score"], 6), r["state"], r["event_count"]) for r in E.snapshot(t, until).collect()}
    for name, series in per.items():
        after, changes, end = loop(series, until)
        got = [(round(r["score"], 6), r["state"], r["event_count"], r["born_us"]) for r in rows if r["entity_id"] == name]
        assert got == after, name
        have = sorted((m["us"], m["from_state"], m["to_state"], m["score"], m["cause"]) for m in moves if m["entity_id"] == name)
        assert have == sorted(changes), name
        assert snap.get(name) == end, name
    assert math.isfinite(sum(r["score"] for r in rows))
