"""Streaming forms of the stateful operators.

Each keeps only what its horizon needs, per key, ends its state by an event-time timer, and gives the same rows as its
batch form. Rows of a key are taken in event order within a micro-batch, and as they come across micro-batches. Rows behind
the watermark or of an older scan are returned on request (``keep_late``), never lost.
"""

from __future__ import annotations

import math
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from hostwarden.config import Config, CorrelatorConfig, ResourceGuardConfig, Thresholds
from hostwarden.functions import expr as X
from hostwarden.operators.correlation import BEACON_HISTORY, has_pid
from hostwarden.operators.network_monitor import CONNECTIONS_FOR_RATE, PERIOD_SEC, PORTS_FOR_SCAN, active
from hostwarden.operators.patterns import BEACON, DEFAULT_PATTERNS, Pattern, node_flags
from hostwarden.streaming.stateful import CHUNK, SEC, Crowd, Memory, Processor, used, with_state

#: Snapshot state of a host is spread over so many keys.
BUCKETS = 16
DAY_SEC = 86_400


def _finished(df: DataFrame, keep_late: bool) -> DataFrame:
    return df if keep_late else used(df)


# --- snapshot diff ------------------------------------------------------------------
def _with_ticks(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows(host_id, bucket, us, seq, ...)`` and a tick of every scan for every bucket of its host.

    A scan is known to all buckets even if none of its rows falls there. Each task adds ticks for the scans it sees;
    repeated ones do no harm.
    """
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", tick boolean"

    blank = {"boolean": False, "int": 0, "bigint": 0, "string": ""}
    filler = {f.name: blank[f.dataType.simpleString()] for f in rows.schema.fields}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set = set()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.zeros(len(batch), bool))], [*batch.schema.names, "tick"])
            scans = set(zip(batch["host_id"].to_pylist(), batch["us"].to_pylist())) - known
            known |= scans
            ticks = [{**filler, "host_id": host, "bucket": bucket, "us": us, "tick": True} for host, us in scans for bucket in range(buckets)]
            columns = [pa.array([t[f.name] for t in ticks], f.type) for f in batch.schema]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.ones(len(ticks), bool))], [*batch.schema.names, "tick"])

    return rows.mapInArrow(add, ddl)


def _bucket(buckets: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int").alias("bucket")


class _Scans(Processor):
    """State of a bucket of a host's items: its clock (current and previous scan) and when each item was last seen."""

    VALUES = {"clock": "now bigint, before bigint, reset bigint"}
    MAPS = {"seen": ("item string", "us bigint")}
    ORDER = ("us", "tick", "seq")

    def __init__(self, keys, out_ddl, event_time, forget_sec: int):
        super().__init__(keys, out_ddl, event_time)
        self.forget_us = forget_sec * SEC

    def turn(self, us: int, memory: Memory) -> bool:
        """Move to the scan at ``us``; False when it is older than the current one."""
        now, before, reset = memory["clock"] or (None, None, None)
        if now is not None and us < now:
            return False
        if now is None or us > now:
            reset = us if reset is None or us - reset > PERIOD_SEC * SEC else reset
            memory["clock"] = (us, now, reset)
            for item, (last,) in memory.maps["seen"].items():
                if now is None or last < now:
                    memory.maps["seen"].remove(item)
        return True

    def is_new(self, item: str, us: int, memory: Memory) -> bool:
        """Whether the item was in neither the previous nor, so far, the current scan; now it is."""
        known = item in memory.maps["seen"]
        memory.maps["seen"].put(item, us)
        return not known

    def refused(self, row):
        return None if row["tick"] else super().refused(row)

    def due(self, memory):
        return None if memory["clock"] is None else memory["clock"][0] + self.forget_us

    def step(self, key, rows, memory):
        out = []
        for row in rows:
            if not self.turn(row["us"], memory):
                if (late := self.refused(row)) is not None:
                    out.append(late)
            elif not row["tick"]:
                out += self.take(row, memory)
        return out


class _Appeared(_Scans):
    def take(self, row, memory):
        return [row] if self.is_new(row["item"], row["us"], memory) else []


def appeared(
    snapshots: DataFrame, key_columns: list[str], buckets: int = BUCKETS, forget_sec: int = DAY_SEC, delay: str = "1 minute", keep_late: bool = False,
) -> DataFrame:
    """Rows whose key was not in the host's previous scan. State: the keys of two scans, per (host, bucket of keys).

    A host that is silent for ``forget_sec`` starts afresh.
    """
    item = F.concat_ws("\u0001", *key_columns)
    rows = snapshots.withWatermark("scan_ts", delay).select(
        "host_id", _bucket(buckets, *key_columns), X.micros("scan_ts").alias("us"), "seq", item.alias("item")
    )
    ddl = "host_id string, bucket int, us bigint, seq bigint, item string"
    out = with_state(_with_ticks(rows, buckets), ["host_id", "bucket"], _Appeared, ddl, forget_sec=forget_sec)
    return _finished(out.drop("bucket"), keep_late)


class _Files(Crowd):
    VALUES = {"file": "us bigint, hash string, size bigint"}
    ORDER = ("us",)

    def __init__(self, keys, out_ddl, event_time, forget_sec: int):
        super().__init__(keys, out_ddl, event_time)
        self.forget_us = forget_sec * SEC

    def step(self, key, rows, memory):
        out = []
        for row in rows:
            held = memory["file"]
            if held is not None and row["us"] < held[0]:
                out.append(self.refused(row))
                continue
            if held is not None and held[1] != row["hash"]:
                out.append({"us": row["us"], "prev_hash": held[1], "new_hash": row["hash"], "prev_size": held[2], "new_size": row["size"]})
            memory["file"] = (row["us"], row["hash"], row["size"])
        return out

    def due(self, memory):
        return None if memory["file"] is None else memory["file"][0] + self.forget_us


def modified_files(files: DataFrame, forget_sec: int = DAY_SEC, delay: str = "1 minute", keep_late: bool = False) -> DataFrame:
    """File changes against the last seen state of each path; a path not seen for ``forget_sec`` is forgotten."""
    rows = files.withWatermark("scan_ts", delay).select("host_id", "path", X.micros("scan_ts").alias("us"), "hash", "size")
    ddl = "host_id string, path string, us bigint, prev_hash string, new_hash string, prev_size bigint, new_size bigint"
    return _finished(with_state(rows, ["host_id", "path"], _Files, ddl, forget_sec=forget_sec), keep_late)


# --- sliding and tumbling counts -------------------------------------------------------
class _Sliding(Crowd):
    VALUES = {"times": "us array<bigint>"}

    def __init__(self, keys, out_ddl, event_time, window_us: int, inclusive: bool):
        super().__init__(keys, out_ddl, event_time)
        self.window_us, self.inclusive = window_us, inclusive

    def step(self, key, rows, memory):
        times, out = list((memory["times"] or ([],))[0]), []
        first = 0
        for row in rows:
            times.append(row["us"])
            cutoff = row["us"] - self.window_us - self.inclusive
            while times[first] <= cutoff:
                first += 1
            out.append({"us": row["us"], "seq": row["seq"], "n": len(times) - first})
        if rows:
            memory["times"] = (times[first:],)
        return out

    def due(self, memory):
        return None if memory["times"] is None else memory["times"][0][-1] + self.window_us + 1


def sliding_count(rows: DataFrame, keys: list[str], window_sec: int, inclusive: bool = True, delay: str = "1 minute", keep_late: bool = False) -> DataFrame:
    """Rows of the key in the window ending at each row. Input: the keys, ``us`` and ``seq``."""
    types = dict(rows.dtypes)
    timed = rows.select(*keys, "us", "seq", F.timestamp_micros("us").alias("ts")).withWatermark("ts", delay).drop("ts")
    ddl = ", ".join(f"{k} {types[k]}" for k in keys) + ", us bigint, seq bigint, n bigint"
    return _finished(with_state(timed, keys, _Sliding, ddl, window_us=window_sec * SEC, inclusive=inclusive), keep_late)


class _Network(_Scans):
    """Also the counters of the current period, per pid of the bucket."""

    MAPS = {
        "seen": ("item string", "us bigint"),
        "counts": ("pid int", "n bigint, ports bigint, scanned boolean, rated boolean"),
        "ports": ("pid_port string", "one int"),
    }

    def __init__(self, keys, out_ddl, event_time, forget_sec: int, suspicious: frozenset[int]):
        super().__init__(keys, out_ddl, event_time, forget_sec)
        self.suspicious = suspicious

    def turn(self, us, memory):
        reset = (memory["clock"] or (None, None, None))[2]
        current = super().turn(us, memory)
        if memory["clock"][2] != reset:
            memory.maps["counts"].empty()
            memory.maps["ports"].empty()
        return current

    def take(self, row, memory):
        if not row["active"]:
            return []
        pid, port = row["pid"], row["remote_port"]
        n, ports, scanned, rated = memory.maps["counts"].get(pid, (0, 0, False, False))
        n += 1
        if f"{pid}|{port}" not in memory.maps["ports"]:
            memory.maps["ports"].put(f"{pid}|{port}", 1)
            ports += 1
        out = []
        if self.is_new(f"{pid}|{row['local_port']}|{row['remote_addr']}|{port}", row["us"], memory):
            base = {c: row[c] for c in ("us", "seq", "pid", "remote_addr", "remote_port")}
            if ports >= PORTS_FOR_SCAN and not scanned:
                scanned = True
                out.append({**base, "kind": "port_scan", "n": ports})
            if port in self.suspicious:
                out.append({**base, "kind": "suspicious_port", "n": None})
            elif n <= CONNECTIONS_FOR_RATE:
                out.append({**base, "kind": "new_outbound", "n": None})
            elif not rated:
                rated = True
                out.append({**base, "kind": "high_conn_rate", "n": n})
        memory.maps["counts"].put(pid, n, ports, scanned, rated)
        return out


def network_verdicts(
    connections: DataFrame, cfg: Config = Config(), buckets: int = BUCKETS, forget_sec: int = DAY_SEC, delay: str = "1 minute", keep_late: bool = False,
) -> DataFrame:
    """Network events with the host's counter period. State per (host, bucket of pids): one period's counters, two scans' keys."""
    rows = connections.withWatermark("scan_ts", delay).select(
        "host_id", _bucket(buckets, "pid"), X.micros("scan_ts").alias("us"), "seq", "pid", "local_port", "remote_addr", "remote_port",
        F.coalesce(_is_active(), F.lit(False)).alias("active"),
    )
    ddl = "host_id string, bucket int, us bigint, seq bigint, pid int, remote_addr string, remote_port int, kind string, n bigint"
    out = with_state(
        _with_ticks(rows, buckets), ["host_id", "bucket"], _Network, ddl, forget_sec=forget_sec, suspicious=frozenset(cfg.suspicious_ports)
    )
    return _finished(out.drop("bucket"), keep_late)


def _is_active():
    return F.col("status").isin("ESTABLISHED", "SYN_SENT") & ~F.coalesce("remote_addr", F.lit("")).isin("127.0.0.1", "::1", "")


def minute_counts(connections: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Clock-aligned variant: active connections and distinct ports per (host, pid, minute), late rows dropped."""
    return (
        active(connections).withWatermark("scan_ts", delay)
        .groupBy("host_id", "pid", F.window("scan_ts", "1 minute"))
        .agg(F.count(F.lit(1)).alias("connections"), F.size(F.collect_set("remote_port")).alias("ports"))
        .select("host_id", "pid", F.col("window.start").alias("minute"), "connections", "ports")
    )


# --- correlation ----------------------------------------------------------------------
def _regular(times: list[int]) -> bool:
    if len(times) < 5:
        return False
    gaps = [(b - a) / SEC for a, b in zip(times, times[1:])]
    mean = sum(gaps) / len(gaps)
    spread = math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps))
    return mean >= 1 and spread < mean * 0.15


class _Correlate(Crowd):
    """State per (host, pid): the latest event of each entity within the retention, the last 20 times per address.

    Nodes are held in order of time, so a row only touches the nodes that enter or leave the window, not all of them.
    """

    MAPS = {
        "nodes": ("entity string", "us bigint, seq bigint, source string, flags array<int>, addr string"),
        "beacons": ("addr string", "times array<bigint>"),
    }

    def __init__(self, keys, out_ddl, event_time, cfg: CorrelatorConfig, flags: int, payload: list[str]):
        super().__init__(keys, out_ddl, event_time)
        self.grid, self.keep, self.window = cfg.prune_every_sec * SEC, cfg.retention_sec * SEC, cfg.time_window_sec * SEC
        self.flags, self.payload = flags, payload

    def step(self, key, rows, memory):
        if key["pid"] < 0:
            return [{c: row[c] for c in ("us", "seq", *self.payload)} for row in rows]
        nodes, beacons = memory.maps["nodes"], memory.maps["beacons"]
        by_time = OrderedDict(sorted(nodes.items(), key=lambda n: n[1][:2]))
        sources = Counter(n[2] for n in by_time.values())
        live: OrderedDict[str, tuple] = OrderedDict()
        counts, addresses, regular = [0] * self.flags, Counter(), {}

        def enter(entity, node):
            live[entity] = node
            for i, f in enumerate(node[3]):
                counts[i] += f
            if node[4]:
                addresses[node[4]] += 1

        def leave(entity):
            node = live.pop(entity)
            for i, f in enumerate(node[3]):
                counts[i] -= f
            if node[4]:
                addresses[node[4]] -= 1
                if not addresses[node[4]]:
                    del addresses[node[4]]

        for entity, node in by_time.items():
            if rows and node[0] > rows[0]["us"] - self.window:
                enter(entity, node)
        out, pruned_to = [], None
        for row in rows:
            now, entity = row["us"], row["entity_id"]
            cutoff = now // self.grid * self.grid - self.keep
            if cutoff != pruned_to:
                # A prune of the grid: old nodes and times go, and what is left of the times may be regular or not.
                pruned_to = cutoff
                regular.clear()
                while by_time and (first := next(iter(by_time.items())))[1][0] < cutoff:
                    del by_time[first[0]]
                    sources[first[1][2]] -= 1
                    nodes.remove(first[0])
                    if first[0] in live:
                        leave(first[0])
                for addr, (times,) in beacons.items():
                    if times[-1] <= cutoff:
                        beacons.remove(addr)
            while live and (first := next(iter(live.items())))[1][0] <= now - self.window:
                leave(first[0])
            if addr := row["addr"]:
                times = [t for t in beacons.get(addr, ([],))[0] if t > cutoff][1 - BEACON_HISTORY :] + [now]
                beacons.put(addr, times)
                regular.pop(addr, None)
            if entity in by_time:
                sources[by_time.pop(entity)[2]] -= 1
            if entity in live:
                leave(entity)
            node = (now, row["seq"], row["source"], [int(f) for f in row["flags"]], addr)
            by_time[entity] = node
            sources[row["source"]] += 1
            nodes.put(entity, *node)
            enter(entity, node)
            for a in addresses:
                if a not in regular:
                    regular[a] = _regular([t for t in beacons.get(a, ([],))[0] if t > cutoff])
            out.append({
                "us": now, "seq": row["seq"], "source_count": sum(n > 0 for n in sources.values()), "related_count": len(live) - 1,
                "counts": list(counts), "beacons": sum(regular[a] for a in addresses), **{c: row[c] for c in self.payload},
            })
        return out

    def due(self, memory):
        newest = max((n[0] for _, n in memory.maps["nodes"].items()), default=None)
        # The first grid line whose prune removes the newest node.
        return None if newest is None else ((newest + self.keep) // self.grid + 1) * self.grid


def correlate(
    events: DataFrame, cfg: CorrelatorConfig = CorrelatorConfig(), patterns: tuple[Pattern, ...] = DEFAULT_PATTERNS,
    payload: tuple[str, ...] = (), delay: str | None = "1 minute", event_time: bool = False, keep_late: bool = False, keep_alone: bool = False,
) -> DataFrame:
    """Source count and live-node counts per event; pattern tests then run as Columns on the counts.

    ``payload`` columns travel along. With ``delay=None`` the stream has its watermark already; ``event_time`` adds ``ts`` for a further
    stateful operator. ``keep_alone`` passes events without a pid through, spread over keys of their own, with a null pid and no counts.
    """
    flags = node_flags(patterns)
    names = list(flags)
    stream = events if delay is None else events.withWatermark("ts", delay)
    alone = -1 - F.pmod(F.xxhash64("seq"), F.lit(4 * BUCKETS)).cast("int")
    rows = (stream if keep_alone else stream.where(has_pid())).select(
        "host_id", F.when(has_pid(), F.col("pid")).otherwise(alone).alias("pid"), X.micros("ts").alias("us"), "seq", "entity_id", "source",
        F.when(F.col("source") == "network", F.coalesce("remote_addr", F.lit(""))).otherwise("").alias("addr"),
        F.array(*[c.cast("int") for c in flags.values()]).alias("flags") if names else F.array().cast("array<int>").alias("flags"),
        *[c for c in payload if c not in ("entity_id", "source")],
    )
    types = dict(rows.dtypes)
    ddl = "host_id string, pid int, us bigint, seq bigint, source_count int, related_count int, counts array<int>, beacons int"
    ddl += "".join(f", {c} {types[c]}" for c in payload)
    counted = with_state(rows, ["host_id", "pid"], _Correlate, ddl, event_time=event_time, cfg=cfg, flags=len(names), payload=list(payload))
    live = {n: F.col("counts")[i] for i, n in enumerate(names)} | {BEACON: F.col("beacons")}
    hits = [(p, p.test(live)) for p in patterns]
    bonus = F.lit(0.0)
    for p, t in hits:
        bonus = bonus + F.when(t, p.bonus).otherwise(0.0)
    out = counted.select(
        "host_id", F.when(F.col("pid") >= 0, F.col("pid")).alias("pid"), "us", "seq", *payload, "source_count", F.coalesce("related_count", F.lit(0)).alias("related_count"),
        F.array_compact(F.array(*[F.when(t, p.name) for p, t in hits])).alias("patterns"), bonus.alias("pattern_bonus"), "late", *(["ts"] if event_time else []),
    )
    return _finished(out, keep_late)


# --- risk state --------------------------------------------------------------------------
class _Risk(Crowd):
    """The risk state of an entity, typed, so that the state store can be read as a table of entities (``plans.live``)."""

    VALUES = {"risk": "score double, state int, events bigint, first_us bigint, last_us bigint, seq bigint, source string, line bigint"}

    def __init__(self, keys, out_ddl, event_time, th: Thresholds, payload: list[str]):
        super().__init__(keys, out_ddl, event_time)
        self.line_us, self.per, self.evict_us = th.tick_sec * SEC, th.decay_per_tick, th.evict_after_sec * SEC
        self.bounds, self.payload = (th.blocked, th.threat, th.suspicious, th.watching), payload

    def rank(self, score: float) -> int:
        return next((4 - i for i, b in enumerate(self.bounds) if score >= b), 0)

    def eviction_line(self, m: tuple) -> int:
        """First grid line at which the score is 0 and the last event old enough."""
        score, last, line = m[0], m[4], m[7]
        return max(line + max(math.ceil(score / self.per), 1), (last + self.evict_us) // self.line_us + 1)

    def decayed(self, m: tuple, line: int) -> tuple[list[dict], tuple | None]:
        """Grid lines up to ``line``: the state changes, one computed line each, and what is left."""
        score, state, events, first, last, seq, source, start = m
        if state == 4 or line <= start:
            return [], m
        out = []
        while state > 0:
            leaves = start + math.floor((score - self.bounds[4 - state]) / self.per) + 1
            if leaves > line:
                break
            score = max(score - (leaves - start) * self.per, 0.0)
            start, new = leaves, self.rank(score)
            out.append({"us": leaves * self.line_us, "seq": seq, "from_state": state, "to_state": new, "score": score, "cause": "decay"})
            state = new
        if line >= self.eviction_line((score, state, events, first, last, seq, source, start)):
            return out, None
        return out, (max(score - (line - start) * self.per, 0.0), state, events, first, last, seq, source, line)

    def step(self, key, rows, memory):
        out = []
        for row in rows:
            m, line = memory["risk"], row["us"] // self.line_us
            if m is not None:
                changes, m = self.decayed(m, line)
                out += changes
            score, state, events, first, _, _, source, _ = m or (0.0, 0, 0, row["us"], None, None, row["source"], None)
            score, events = score + row["x"], events + 1
            new = 4 if state == 4 else self.rank(score)
            out.append({
                "us": row["us"], "seq": row["seq"], "from_state": state, "to_state": new, "score": score, "cause": "event" if new != state else "none",
                **{c: row[c] for c in self.payload},
            })
            memory["risk"] = (score, new, events, first, row["us"], row["seq"], source, max(line, m[7] if m else line))
        return out

    def on_time(self, key, memory, watermark):
        out, memory["risk"] = self.decayed(memory["risk"], watermark // self.line_us)
        return out

    def due(self, memory):
        m = memory["risk"]
        if m is None or m[1] == 4:
            return None
        if m[1] == 0:
            return self.eviction_line(m) * self.line_us
        return (m[7] + math.floor((m[0] - self.bounds[4 - m[1]]) / self.per) + 1) * self.line_us


def track_risk(
    scored: DataFrame, th: Thresholds = Thresholds(), score_col: str = "score", payload: tuple[str, ...] = (), delay: str | None = "1 minute",
) -> DataFrame:
    """Every event with its entity's state before and after, and every state change by decay: ``cause`` is none, event or decay.

    An event-time timer wakes an idle entity for its next change or eviction. Blocked entities stay. Late rows carry ``late``.
    """
    stream = scored if delay is None else scored.withWatermark("ts", delay)
    marked = [c for c in ("late",) if c in scored.columns]
    rows = stream.select(*marked, "host_id", "entity_id", X.micros("ts").alias("us") if not marked else F.coalesce("us", X.micros("ts")).alias("us"), "seq", F.col(score_col).cast("double").alias("x"), "source", *[c for c in payload if c != "source"])
    types = dict(rows.dtypes)
    ddl = "host_id string, entity_id string, us bigint, seq bigint, from_state int, to_state int, score double, cause string"
    ddl += "".join(f", {c} {types[c]}" for c in payload)
    return with_state(rows, ["host_id", "entity_id"], _Risk, ddl, th=th, payload=list(payload))


def risk_transitions(
    scored: DataFrame, th: Thresholds = Thresholds(), score_col: str = "score", delay: str = "1 minute", keep_late: bool = False,
) -> DataFrame:
    """State changes by event and by decay."""
    return _finished(track_risk(scored, th, score_col, (), delay).where("late OR cause <> 'none'"), keep_late)


# --- resource guard ---------------------------------------------------------------------------
class _Cooldown(Crowd):
    VALUES = {"last": "us bigint"}

    def __init__(self, keys, out_ddl, event_time, wait_us: int):
        super().__init__(keys, out_ddl, event_time)
        self.wait_us = wait_us

    def step(self, key, rows, memory):
        out = []
        for row in rows:
            if memory["last"] is None or row["us"] - memory["last"][0] >= self.wait_us:
                memory["last"] = (row["us"],)
                out.append({"us": row["us"], "seq": row["seq"]})
        return out

    def due(self, memory):
        return None if memory["last"] is None else memory["last"][0] + self.wait_us


def cooldown(candidates: DataFrame, cooldown_sec: int = ResourceGuardConfig().cooldown_sec, delay: str = "1 minute", keep_late: bool = False) -> DataFrame:
    """Keep a candidate when the last kept one of its (host, pid, kind, life) is 60 s old. Input carries ``us`` and ``seq``."""
    keys = ["host_id", "pid", "kind", "life"]
    rows = candidates.select(*keys, "us", "seq", F.timestamp_micros("us").alias("ts")).withWatermark("ts", delay).drop("ts")
    ddl = "host_id string, pid int, kind string, life int, us bigint, seq bigint"
    return _finished(with_state(rows, keys, _Cooldown, ddl, wait_us=cooldown_sec * SEC), keep_late)


class _Baseline(Crowd):
    VALUES = {"cpu": "n bigint, mean double, m2 double, last bigint"}

    def __init__(self, keys, out_ddl, event_time, forget_sec: int):
        super().__init__(keys, out_ddl, event_time)
        self.forget_us = forget_sec * SEC

    def step(self, key, rows, memory):
        out = []
        n, mean, m2, last = memory["cpu"] or (0, 0.0, 0.0, 0)
        for row in rows:
            off = row["cpu_pct"] - mean
            n, last = n + 1, max(last, row["us"])
            mean += off / n
            m2 += off * (row["cpu_pct"] - mean)
            out.append({"us": row["us"], "seq": row["seq"], "base_mean": mean, "base_std": math.sqrt(m2 / (n - 1)) if n > 1 else 0.0})
        if rows:
            memory["cpu"] = (n, mean, m2, last)
        return out

    def due(self, memory):
        return None if memory["cpu"] is None else memory["cpu"][3] + self.forget_us


def cpu_baseline(samples: DataFrame, forget_sec: int = 7 * DAY_SEC, delay: str = "1 minute", keep_late: bool = False) -> DataFrame:
    """Running mean and sample stddev of CPU per (host, name), one update per sample; a name unused for ``forget_sec`` starts anew."""
    rows = samples.withWatermark("scan_ts", delay).select("host_id", "name", X.micros("scan_ts").alias("us"), "seq", "cpu_pct")
    ddl = "host_id string, name string, us bigint, seq bigint, base_mean double, base_std double"
    return _finished(with_state(rows, ["host_id", "name"], _Baseline, ddl, forget_sec=forget_sec), keep_late)


# --- behaviour features -----------------------------------------------------------------------------
class _HostRates(Processor):
    """Times of a host's process and file events, per 5-minute slice: a slice sees its own rows and those of the one before.

    A slice may be most of a micro-batch, so its rows stay Arrow columns and are counted as columns.
    """

    VALUES = {"times": "procs array<bigint>, files array<bigint>, last bigint"}
    COUNTED = {"procs": "process", "files": "filesystem"}

    def __init__(self, keys, out_ddl, event_time, window_us: int, columns: pa.Schema):
        super().__init__(keys, out_ddl, event_time)
        self.window_us, self.columns = window_us, columns

    def handleInputRows(self, key, rows, timerValues):
        watermark, memory = timerValues.getCurrentWatermarkInMs() * 1000, Memory(self.values, self.map_states)
        table = pa.concat_tables([pa.Table.from_pandas(part, self.columns, preserve_index=False) for part in rows])
        order = pc.sort_indices(table, sort_keys=[("us", "ascending"), ("seq", "ascending")]).to_numpy()
        us, own = table["us"].to_numpy()[order], table["own"].to_numpy()[order]
        current = us >= watermark
        held = memory["times"] or ([], [], 0)
        counts, kept = {}, []
        for known, (name, source) in zip(held, self.COUNTED.items()):
            enters = pc.fill_null(pc.equal(table["source"], source), False).to_numpy()[order] & current
            times = np.concatenate([np.array(known, "int64"), us[enters]])
            # Times leave from the front, each after those before it; what a row counts entered by it and has not left.
            left = np.searchsorted(np.maximum.accumulate(times), us - self.window_us, "right")
            counts[name] = len(known) + np.cumsum(enters) - left
            last = left[own & current][-1:]
            kept.append(times[last[0] if len(last) else 0 :].tolist())
        if current.any():
            memory["times"] = (*kept, max(held[2], int(us[current][-1])))
        memory.save()
        self._arm(memory, watermark, self.alarm.get()[0] if self.alarm.exists() else None)
        # A late row is reported by its own slice; its copy for the next one goes in silence.
        mine = np.flatnonzero(own)
        for start in range(0, len(mine), CHUNK):
            at = mine[start : start + CHUNK]
            frame = table.take(order[at]).to_pandas(types_mapper={pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}.get)
            counted = {name: pd.arrays.IntegerArray(n[at], ~current[at]) for name, n in counts.items()}
            yield self._timed(frame.assign(**dict(zip(self.keys, key)), **counted, late=~current[at]), watermark).reindex(columns=self.names)

    def due(self, memory):
        # Rows of the slice and of the one before end with the slice.
        return None if memory["times"] is None else (memory["times"][2] // self.window_us + 2) * self.window_us


class _Activity(Crowd):
    """The connection session of a process: its count, first uses of addresses and ports, and the times still in the window."""

    VALUES = {"session": "n bigint, times array<bigint>"}
    MAPS = {"addresses": ("address string", "us bigint"), "ports": ("port int", "us bigint")}

    def __init__(self, keys, out_ddl, event_time, window_us: int):
        super().__init__(keys, out_ddl, event_time)
        self.window_us = window_us

    def step(self, key, rows, memory):
        out = []
        n, times = memory["session"] or (0, [])
        times, first = list(times), 0
        addresses, ports = memory.maps["addresses"], memory.maps["ports"]
        for row in rows:
            while first < len(times) and times[first] <= row["us"] - self.window_us:
                first += 1
            if n and first == len(times):
                n, times, first = 0, [], 0
                addresses.empty()
                ports.empty()
            if row["source"] == "network":
                n += 1
                times.append(row["us"])
                for known, value in ((addresses, row["remote_addr"]), (ports, row["remote_port"])):
                    if value is not None and value not in known:
                        known.put(value, row["us"])
            alive = len(times) - first
            gap = (times[-1] - times[first]) / 1e6 / (alive - 1) if alive > 1 else 0.0
            per_minute = self.window_us / SEC / 60.0
            out.append({
                "us": row["us"], "seq": row["seq"], "conn_per_min": n / per_minute, "unique_ips": float(len(addresses)), "unique_ports_f": float(len(ports)),
                "avg_interval": gap, "proc_per_min": row["procs"] / per_minute, "file_mods_per_min": row["files"] / per_minute,
            })
        if rows:
            memory["session"] = (n, times[first:]) if n else None
        return out

    def due(self, memory):
        return None if memory["session"] is None else memory["session"][1][-1] + self.window_us


def features(events: DataFrame, window_sec: int = 300, delay: str | None = "1 minute", keep_late: bool = False) -> DataFrame:
    """The six behaviour features of every event: ``host_id, us, seq`` and ``schema.FEATURES``.

    Two stateful operators in a row: host rates per (host, 5-minute slice), then activity per (host, pid). Both end their
    state by event-time timers: a slice with the one after it, a session 5 minutes after its last connection.
    """
    width = window_sec * SEC
    us = X.micros("ts")
    stream = events if delay is None else events.withWatermark("ts", delay)
    # The watermark's column ends here; the operators judge lateness themselves and report it.
    rows = stream.select(
        "host_id", us.alias("us"), "seq", "source", F.coalesce("pid", F.lit(0)).alias("pid"), "remote_addr", "remote_port",
        F.explode(F.when(F.col("source").isin("process", "filesystem"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("ahead"),
    ).withColumns({"own": F.col("ahead") == 0, "slice": F.call_function("div", F.col("us"), F.lit(width)) + F.col("ahead")}).drop("ahead")
    payload = ["pid", "source", "remote_addr", "remote_port"]
    types = dict(rows.dtypes)
    ddl = "host_id string, slice bigint, us bigint, seq bigint, procs bigint, files bigint" + "".join(f", {c} {types[c]}" for c in payload)
    columns = to_arrow_schema(rows.select("us", "seq", "own", *payload).schema)
    rated = with_state(rows, ["host_id", "slice"], _HostRates, ddl, event_time=True, window_us=width, columns=columns)
    out = with_state(
        rated.drop("slice", "ts"), ["host_id", "pid"], _Activity,
        "host_id string, pid int, us bigint, seq bigint, conn_per_min double, unique_ips double, unique_ports_f double, avg_interval double, proc_per_min double, file_mods_per_min double",
        window_us=width,
    ).drop("pid")
    return _finished(out, keep_late)


# --- plain aggregates -----------------------------------------------------------------------------
def feedback_totals(feedback: DataFrame) -> DataFrame:
    """Label counts per rule, for a complete-mode sink (one row per rule name)."""
    fp = F.coalesce(F.col("false_positive"), F.lit(False)).cast("int")
    return feedback.groupBy("rule_name").agg(
        F.count(F.lit(1)).alias("total"), F.sum(1 - fp).alias("true_positives"), F.sum(fp).alias("false_positives")
    )


class _Gate(Processor):
    """Passes rows on and marks those behind the watermark; keeps nothing."""

    def step(self, key, rows, memory):
        return list(rows)

    def due(self, memory):
        return None


def gated(events: DataFrame, columns: list[str], buckets: int = BUCKETS, delay: str = "1 minute") -> DataFrame:
    """``host_id, us, seq`` and ``columns`` with ``late`` and a watermarked ``ts``: an operator of Spark that drops late rows can follow."""
    rows = events.withWatermark("ts", delay).select("host_id", _bucket(buckets, "seq"), X.micros("ts").alias("us"), "seq", *columns)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return with_state(rows, ["host_id", "bucket"], _Gate, ddl, event_time=True).drop("bucket")


def windowed_kinds(events: DataFrame, width: str = "5 minutes", delay: str = "1 minute") -> DataFrame:
    """Events per host, kind and tumbling window; rows later than the watermark are dropped and counted by Spark.

    ``late(gated(events, []))``, as a query of its own with the same input and trigger, returns the dropped rows.
    """
    return events.withWatermark("ts", delay).groupBy("host_id", "kind", F.window("ts", width)).agg(
        F.count(F.lit(1)).alias("n")
    ).select("host_id", "kind", F.col("window.start").alias("window_start"), "n")
