"""Keyed streaming state with an end: typed values and maps, one event-time timer a key, late rows kept.

A ``Processor`` declares its state by name and type. Its ``step`` sees the rows of a key and micro-batch in event order;
what it changes in its ``Memory`` is written back entry by entry. ``due`` tells when the key's memory may end; a timer
wakes the key then, and ``on_time`` answers. Rows behind the watermark, and rows that ``step`` refuses, are not dropped:
they leave as rows with ``late`` set, with their key, time and number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any, ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hostwarden.schema import struct

SEC = 1_000_000
#: The keys of a host share so many groups.
CROWDS = 256
#: Rows of a group that are Python objects at a time.
CHUNK = 10_000


class Entries:
    """One map of a key, read when it is first used; remembers which entries changed."""

    def __init__(self, state):
        self._state = state
        self._data: dict | None = None
        self._changed: set = set()
        self._emptied = False

    @property
    def data(self) -> dict:
        if self._data is None:
            self._data = {k[0]: tuple(v) for k, v in self._state.iterator()} if self._state.exists() else {}
        return self._data

    def __contains__(self, key) -> bool:
        return key in self.data

    def __len__(self) -> int:
        return len(self.data)

    def get(self, key, default=None):
        return self.data.get(key, default)

    def items(self):
        return list(self.data.items())

    def put(self, key, *value) -> None:
        self.data[key] = value
        self._changed.add(key)

    def remove(self, key) -> None:
        if self.data.pop(key, None) is not None:
            self._changed.add(key)

    def empty(self) -> None:
        self._data, self._changed, self._emptied = {}, set(), True

    def save(self) -> None:
        if self._emptied and self._state.exists():
            self._state.clear()
        for key in self._changed:
            if key in self.data:
                self._state.updateValue((key,), self.data[key])
            elif not self._emptied and self._state.containsKey((key,)):
                self._state.removeKey((key,))


class Memory:
    """The state of one key: ``memory["name"]`` is a value (a tuple or None), ``memory.maps["name"]`` a map."""

    def __init__(self, values: dict, maps: dict):
        self._states = values
        self._values: dict[str, tuple | None] = {}
        self._changed: set[str] = set()
        self.maps = {name: Entries(state) for name, state in maps.items()}

    def __getitem__(self, name: str) -> tuple | None:
        if name not in self._values:
            state = self._states[name]
            self._values[name] = tuple(state.get()) if state.exists() else None
        return self._values[name]

    def __setitem__(self, name: str, value: tuple | None) -> None:
        self._values[name] = value
        self._changed.add(name)

    def forget(self) -> None:
        for name in self._states:
            self[name] = None
        for entries in self.maps.values():
            entries.empty()

    def save(self) -> None:
        for name in self._changed:
            if self._values[name] is not None:
                self._states[name].update(self._values[name])
            elif self._states[name].exists():
                self._states[name].clear()
        for entries in self.maps.values():
            entries.save()


class Processor(StatefulProcessor):
    """Subclasses set ``VALUES``, ``MAPS``, ``OUT`` and define ``step`` and ``due``."""

    VALUES: ClassVar[dict[str, str]] = {}
    MAPS: ClassVar[dict[str, tuple[str, str]]] = {}
    ORDER: ClassVar[tuple[str, ...]] = ("us", "seq")
    whole: tuple[str, ...] = ()

    def __init__(self, keys: list[str], out_ddl: str, event_time: bool = False):
        self.keys, self.names, self.event_time = keys, [f.name for f in struct(out_ddl).fields], event_time

    # --- what subclasses define
    def step(self, key: dict, rows: list[dict], memory: Memory) -> Iterator[dict]:
        """Output rows; ``self.refused(row)`` for a row that comes too late for this operator."""
        raise NotImplementedError

    def due(self, memory: Memory) -> int | None:
        """Microseconds at which the memory should be looked at again; None if never."""
        raise NotImplementedError

    def on_time(self, key: dict, memory: Memory, watermark: int) -> Iterator[dict]:
        """Called once the watermark has reached ``due``."""
        memory.forget()
        return iter(())

    # --- plumbing
    def refused(self, row: dict) -> dict | None:
        """The late row as it is returned; None for rows that only an operator's own bookkeeping added."""
        return {**row, "late": True}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = {name: handle.getValueState(name, ddl) for name, ddl in self.VALUES.items()}
        self.map_states = {name: handle.getMapState(name, key, value) for name, (key, value) in self.MAPS.items()}
        self.alarm = handle.getValueState("alarm", "ms bigint")

    def _arm(self, memory: Memory, watermark: int, pending: int | None) -> None:
        """At most one timer a key: an earlier one than needed may stay, its wake-up sets the next."""
        due = self.due(memory)
        if due is None:
            return
        at = max(-(-due // 1000), watermark // 1000 + 1)
        if pending is None or at < pending:
            if pending is not None:
                self.handle.deleteTimer(pending)
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def _frame(self, rows: list[dict], key: dict, watermark: int) -> pd.DataFrame:
        for row in rows:
            row.setdefault("late", False)
            row.update(key)
        # Objects, so that what a row lacks is null in columns of any type.
        frame = pd.DataFrame([[row.get(name) for name in self.names] for row in rows], columns=self.names, dtype=object)
        return self._timed(frame, watermark)

    def _timed(self, frame: pd.DataFrame, watermark: int) -> pd.DataFrame:
        if self.event_time:
            frame["ts"] = pd.to_datetime(np.maximum(frame["us"].to_numpy("int64"), watermark), unit="us", utc=True)
        return frame

    def _table(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        table = pd.concat(list(rows), ignore_index=True).sort_values(list(self.ORDER), kind="stable")
        # Whole numbers next to nulls arrive as floating point.
        return table.astype({c: "Int64" for c in self.whole if table[c].dtype.kind == "f"})

    def _advance(self, key: dict, records: list[dict], memory: Memory, watermark: int) -> list[dict]:
        behind = [row["us"] < watermark or bool(row.pop("late", False)) for row in records]
        out = [late for row, b in zip(records, behind) if b and (late := self.refused(row)) is not None]
        out += self.step(key, [row for row, b in zip(records, behind) if not b], memory)
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        named, memory = dict(zip(self.keys, key)), Memory(self.values, self.map_states)
        table = self._table(rows)
        for start in range(0, len(table), CHUNK):
            yield self._frame(self._advance(named, _records(table.iloc[start : start + CHUNK]), memory, watermark), named, watermark)
        memory.save()
        self._arm(memory, watermark, self.alarm.get()[0] if self.alarm.exists() else None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        named, memory = dict(zip(self.keys, key)), Memory(self.values, self.map_states)
        self.alarm.clear()
        due = self.due(memory)
        out = list(self.on_time(named, memory, watermark)) if due is not None and due <= watermark else []
        memory.save()
        self._arm(memory, watermark, None)
        yield self._frame(out, named, watermark)

    def close(self) -> None:
        pass


def _records(table: pd.DataFrame) -> list[dict]:
    return table.astype(object).where(table.notna(), None).to_dict("records")


class _Held(Entries):
    """One map of a key whose memory is read and written as a whole."""

    def __init__(self, data: dict):
        self._data, self._changed, self._emptied = data, set(), False

    @property
    def touched(self) -> bool:
        return self._emptied or bool(self._changed)


def _plain(value: Any) -> Any:
    """A state value with tuples in place of rows, as the state store takes it back."""
    if isinstance(value, tuple):
        return tuple(_plain(v) for v in value)
    return [_plain(v) for v in value] if isinstance(value, list) else value


class _Member(Memory):
    """The memory of one key of a group, an element of the group's list: its values, its maps as arrays, its alarm."""

    def __init__(self, crowd: Crowd, group: _Group, key: tuple):
        self._group, self._key, self._changed = group, key, set()
        n = len(crowd.VALUES)
        held = group.held.get(key) or (None,) * (n + len(crowd.MAPS) + 1)
        self._values = dict(zip(crowd.VALUES, held))
        self.maps = {name: _Held({e[0]: e[1:] for e in v or ()}) for name, v in zip(crowd.MAPS, held[n:])}
        self.alarm, self._alarmed = held[-1], False

    def __getitem__(self, name: str) -> tuple | None:
        return self._values[name]

    def forget(self) -> None:
        for name in self._values:
            self[name] = None
        for entries in self.maps.values():
            entries.empty()

    def wake(self, at: int | None) -> None:
        self.alarm, self._alarmed = at, True

    def save(self) -> None:
        if not (self._changed or self._alarmed or any(m.touched for m in self.maps.values())):
            return
        if any(v is not None for v in self._values.values()) or any(len(m) for m in self.maps.values()):
            maps = [[(k, *v) for k, v in m.items()] for m in self.maps.values()]
            self._group.put(self._key, (*self._values.values(), *maps, self.alarm))
        else:
            self._group.remove(self._key)


class _Group:
    """The memories of a group's keys: read once a micro-batch, and written once if one has changed."""

    def __init__(self, crowd: Crowd):
        self._state, self._changed = crowd.memories, False
        n = len(crowd.keys) - 1
        stored = map(_plain, self._state.get()) if self._state.exists() else ()
        self.held = {m[:n]: m[n:] for m in stored}
        self._known = bool(self.held)

    def put(self, key: tuple, held: tuple) -> None:
        self.held[key], self._changed = held, True

    def remove(self, key: tuple) -> None:
        if self.held.pop(key, None) is not None:
            self._changed = True

    def save(self) -> int | None:
        """The earliest alarm of its keys."""
        if self._changed and self.held:
            self._state.put([(*key, *held) for key, held in self.held.items()])
        elif self._changed and self._known:
            self._state.clear()
        return min((held[-1] for held in self.held.values() if held[-1] is not None), default=None)


class Crowd(Processor):
    """A processor whose keys share groups, so that what Spark and pandas do once a group and micro-batch is paid for many keys.

    A group holds the memories of its keys as one list, read and written as a whole: a call to the state store costs more than
    many memories in it. It has one timer, for its earliest alarm.
    """

    def hold(self, members: list[T.StructField]) -> None:
        """Fix the types of the state by those of the key's columns within a group; on the driver."""
        values = [T.StructField(name, struct(ddl)) for name, ddl in self.VALUES.items()]
        maps = [T.StructField(name, T.ArrayType(struct(f"{key}, {value}"))) for name, (key, value) in self.MAPS.items()]
        self.held = T.StructType([*members, *values, *maps, T.StructField("alarm", T.LongType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memories = handle.getListState("memories", self.held)
        self.alarm = handle.getValueState("alarm", "ms bigint")

    def _wake(self, memory: _Member, watermark: int) -> None:
        """At most one alarm a key, as ``_arm`` sets timers."""
        due = self.due(memory)
        if due is not None:
            at = max(-(-due // 1000), watermark // 1000 + 1)
            if memory.alarm is None or at < memory.alarm:
                memory.wake(at)
        memory.save()

    def _arm_group(self, at: int | None, pending: int | None) -> None:
        if at is not None and (pending is None or at < pending):
            if pending is not None:
                self.handle.deleteTimer(pending)
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, mine = timerValues.getCurrentWatermarkInMs() * 1000, self.keys[1:]
        table = self._table(rows)
        table = table.iloc[np.argsort(table.groupby(mine, dropna=False, sort=False).ngroup().to_numpy(), kind="stable")]
        group, now, memory = _Group(self), None, None
        for start in range(0, len(table), CHUNK):
            out = []
            for member, own in groupby(_records(table.iloc[start : start + CHUNK]), lambda row: tuple(row[c] for c in mine)):
                if memory is None or member != now:
                    if memory is not None:
                        self._wake(memory, watermark)
                    now, memory = member, _Member(self, group, member)
                named = dict(zip(self.keys, (key[0], *member)))
                out += [{**row, **named} for row in self._advance(named, list(own), memory, watermark)]
            yield self._frame(out, {}, watermark)
        self._wake(memory, watermark)
        self._arm_group(group.save(), self.alarm.get()[0] if self.alarm.exists() else None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        self.alarm.clear()
        group, out = _Group(self), []
        for member in [m for m, held in group.held.items() if held[-1] is not None and held[-1] * 1000 < watermark]:
            memory = _Member(self, group, member)
            memory.wake(None)
            due = self.due(memory)
            if due is not None and due <= watermark:
                named = dict(zip(self.keys, (key[0], *member)))
                out += [{**row, **named} for row in self.on_time(named, memory, watermark)]
            self._wake(memory, watermark)
            if len(out) >= CHUNK:
                yield self._frame(out, {}, watermark)
                out = []
        yield self._frame(out, {}, watermark)
        self._arm_group(group.save(), None)


def with_state(rows: DataFrame, keys: list[str], processor: type[Processor], out_ddl: str, *args, event_time: bool = False, **params) -> DataFrame:
    """Run a processor per key; the keys of a ``Crowd`` share groups within their first column. ``rows`` carry ``us`` and come from a stream with a watermark, but without its column, so
    that Spark does not drop rows behind it before the processor sees them.

    Rows that an earlier operator marked ``late`` stay so. The result has the columns of ``out_ddl`` and ``late``; with ``event_time`` also ``ts``, for a further stateful operator: the
    row's time, or the watermark for a late row.
    """
    ddl = out_ddl + ", late boolean" + (", ts timestamp" if event_time else "")
    worker = processor(keys, ddl, event_time, *args, **params)
    worker.whole = tuple(f.name for f in rows.schema.fields if f.dataType.simpleString() in ("int", "bigint"))
    more = {"eventTimeColumnName": "ts"} if event_time else {}
    if issubclass(processor, Crowd):
        worker.hold([T.StructField(c, rows.schema[c].dataType) for c in keys[1:]])
        rows = rows.withColumn("crowd", F.pmod(F.xxhash64(*keys[1:]), F.lit(CROWDS)).cast("int"))
        keys = [keys[0], "crowd"]
    return rows.groupBy(*keys).transformWithStateInPandas(worker, ddl, "Append", "EventTime", **more)


def used(df: DataFrame) -> DataFrame:
    """Without late rows."""
    return df.where("NOT late").drop("late")


def late(df: DataFrame) -> DataFrame:
    """The late rows of an operator's output: key, time and number."""
    return df.where("late").select(*[c for c in ("host_id", "us", "seq") if c in df.columns])


def observed(df: DataFrame, name: str = "rows") -> DataFrame:
    """Reports the numbers of used and late rows of every micro-batch in the query's progress."""
    return df.observe(name, F.count(F.when(~F.col("late"), 1)).alias("used"), F.count(F.when(F.col("late"), 1)).alias("late"))
