"""Cheapest repair of damaged conversations by a dynamic programme over audit strings.

The repaired roles must read ``(s?(ua)+)?``, so a programme over rows needs four states: nothing yet, after the system
row, after a user row, after an assistant row. Every state keeps its cheapest edits, the least string on ties.

* Edit strings are not copied: a string is a node that points to its prefix (``Audits``). A node knows its ancestors at
  powers of two and a rolling hash of its string, so two strings are compared by a search for their longest common
  prefix. Prefixes that are taken for equal by their hashes are verified once.
* Rows are sorted over all conversations and dealt out by ranges, so a long conversation is spread over many tasks.
  Conversations inside one task are finished there. Others give segments: the cheapest edits from every state at the
  segment's beginning to every state at its end. Two cheapest strings between the same states are never prefixes of
  each other (the longer one would cost more), so the least whole is made of least segments, and segments are joined
  in order. Only the final SHA-256 has to see the bytes of a conversation in sequence; it reads them as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from hostwarden.llm.support import prepare
from hostwarden.session import stage

#: A segment of a conversation has at most so many rows and about so many bytes of text.
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 1 << 20
_BLOCK = 1 << 16
_BASE, _PRIME = 0x1F3D5B79A6C8E421, (1 << 61) - 1

# --- fixed values: what edits cost -----------------------------------------------------------------------------------
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# --- end of fixed values ----------------------------------------------------------------------------------------------
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: State after a row with this initial, by the state before it.
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}


class Audits:
    """Strings as nodes of trees that share prefixes; node 0 is the empty string."""

    def __init__(self, base: int = _BASE, prime: int = _PRIME):
        self.base, self.prime = base, prime
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.up: list[tuple[int, ...]] = [()]  # ancestors 1, 2, 4, ... letters shorter
        self._same: set[tuple[int, int]] = set()

    def add(self, node: int, letter: str) -> int:
        """The string of ``node`` with one more letter."""
        new = len(self.letter)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(letter)) % self.prime)
        ups, at = [node], node
        while len(self.up[at]) >= len(ups):
            at = self.up[at][len(ups) - 1]
            ups.append(at)
        self.up.append(tuple(ups))
        return new

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _ancestor(self, node: int, depth: int) -> int:
        while (more := self.depth[node] - depth) > 0:
            node = self.up[node][more.bit_length() - 1]
        return node

    def _equal(self, x: int, y: int) -> bool:
        """Whether two strings of equal length and hash are equal, letter by letter down to what is known."""
        trail = []
        while x != y and (x, y) not in self._same:
            if self.letter[x] != self.letter[y]:
                return False
            trail.append((x, y))
            x, y = self.up[x][0], self.up[y][0]
        self._same.update(trail)
        return True

    def less(self, x: int, y: int) -> bool:
        """Whether the string of ``x`` is before that of ``y`` in ASCII order."""
        shorter = min(self.depth[x], self.depth[y])
        a, b = self._ancestor(x, shorter), self._ancestor(y, shorter)
        if self.hash[a] == self.hash[b]:
            if self._equal(a, b):
                return self.depth[x] < self.depth[y]
            return self.text(x) < self.text(y)
        step = len(self.up[a]) - 1
        while step >= 0:
            # Strings of equal length: a jump that leads to different hashes stays behind the first difference.
            if step < len(self.up[a]) and self.hash[self.up[a][step]] != self.hash[self.up[b][step]]:
                a, b = self.up[a][step], self.up[b][step]
            step -= 1
        if not self._equal(self.up[a][0], self.up[b][0]):
            return self.text(x) < self.text(y)
        return self.letter[a] < self.letter[b]


class Row(NamedTuple):
    """Rows with equal turn, role and text: ``copies`` of them, the first one with these faults."""

    turn: int | None
    role: str
    text: str
    copies: int
    blank: bool
    duplicate: bool
    truncated: bool


class Way(NamedTuple):
    cost: int
    node: int


Ways = dict[int, Way]


def _offer(audits: Audits, ways: Ways, state: int, cost: int, node: int, letter: str) -> None:
    held = ways.get(state)
    if held is not None and held.cost < cost:
        return
    new = audits.add(node, letter)
    if held is None or cost < held.cost or audits.less(new, held.node):
        ways[state] = Way(cost, new)


def with_insertions(audits: Audits, ways: Ways) -> Ways:
    """Also the states that insertions lead to. A user and an assistant row are the most that can pay."""
    out = dict(ways)
    for state in (START, SYSTEM, ASSISTANT):
        if state in ways:
            _offer(audits, out, USER, ways[state].cost + INSERT, ways[state].node, "I")
    if USER in out:
        _offer(audits, out, ASSISTANT, out[USER].cost + INSERT, out[USER].node, "I")
    return out


def _after_row(audits: Audits, ways: Ways, initial: str, bad: bool, truncated: bool) -> Ways:
    out: Ways = {}
    for state, (cost, node) in with_insertions(audits, ways).items():
        _offer(audits, out, state, cost + DELETE, node, "D")
        if not bad:
            for role, after in FOLLOWS[state].items():
                if initial == role:
                    _offer(audits, out, after, cost + KEEP + TRUNCATED * truncated, node, "K")
                elif role != "s":
                    _offer(audits, out, after, cost + REROLE + TRUNCATED * truncated, node, "R")
    return _worth_keeping(out)


def _worth_keeping(ways: Ways) -> Ways:
    """Without states that cost more than reaching the others' place from another state ever would.

    What follows the start can follow an assistant row if a system row goes (3); what follows an assistant row can follow a user row
    behind one insertion (2) and the other way round; what follows a system row can follow an assistant row.
    """
    far = 1 << 60
    cost = {state: ways[state].cost if state in ways else far for state in range(4)}
    last = min(cost[ASSISTANT], cost[USER] + INSERT)
    limit = {START: last + DELETE, SYSTEM: last, USER: cost[ASSISTANT] + INSERT, ASSISTANT: cost[USER] + INSERT}
    return {state: way for state, way in ways.items() if way.cost <= limit[state]}


def cheapest(rows: Sequence[Row], start: int) -> tuple[Audits, Ways]:
    """Cheapest edits of these rows from one state; insertions behind the last row are not among them."""
    audits = Audits()
    ways: Ways = {start: Way(0, 0)}
    for row in rows:
        ways = _after_row(audits, ways, row.role[:1], row.blank or row.duplicate, row.truncated)
        for _ in range(row.copies - 1):
            ways = _after_row(audits, ways, row.role[:1], True, False)
    return audits, ways


def lines(rows: Sequence[tuple[str, str, int]], audit: str, state: int) -> Iterator[str]:
    """The repaired ``role:text`` lines of rows ``(role, text, copies)`` under these edits."""
    edits = iter(audit)

    def inserted(state: int) -> tuple[int, str]:
        after = ASSISTANT if state == USER else USER
        return after, f"{NAMES[after]}:"

    for role, text, copies in rows:
        for _ in range(copies):
            while (edit := next(edits)) == "I":
                state, line = inserted(state)
                yield line
            if edit == "K":
                state = FOLLOWS[state][role[:1]]
                yield f"{role}:{text}"
            elif edit == "R":
                state = ASSISTANT if state == USER else USER
                yield f"{NAMES[state]}:{text}"
    for _ in edits:
        state, line = inserted(state)
        yield line


# --- damage and faults ----------------------------------------------------------------------------------------------
_SPACES = " \t\n\x0b\x0c\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage as ``conv, turn, role, text, copies``, equal rows of a turn counted together."""
    conv, turn = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.col("turn").cast("long")
    kind = F.crc32(F.concat(conv, F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select(conv.alias("conv"), turn.alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    new = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), new.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").cast("int").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` of ``damaged`` with ``blank``, ``duplicate`` and ``truncated`` of their first copy; at most one is true.

    The first turn of every role and text is an aggregate by (conversation, digest), met again by (conversation, digest,
    turn), which no two rows share, so a text that fills a conversation is no hot key.
    """
    digest: Column = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    rows = rows.withColumn("digest", digest)
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.groupBy("conv", "digest").agg(F.min(order).alias("first")).select(F.col("conv").alias("f_conv"), F.col("digest").alias("f_digest"), F.col("first.turn").alias("f_turn"))
    same = (F.col("conv") == F.col("f_conv")) & (F.col("digest") == F.col("f_digest")) & F.col("turn").eqNullSafe(F.col("f_turn"))
    solid = F.rtrim("text", F.lit(_SPACES))
    blank, late = solid == "", F.col("f_conv").isNull()
    open_end = ~F.substring(solid, -1, 1).isin(".", "!", "?")
    return rows.join(first, same, "left").select(
        "conv", "turn", "role", "text", "copies", blank.alias("blank"), (~blank & late).alias("duplicate"), (~blank & ~late & open_end).alias("truncated")
    )


# --- segments -------------------------------------------------------------------------------------------------------
_PATH = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_PARTS = pa.schema([
    ("conv", pa.string()), ("at", pa.int32()), ("seq", pa.int64()), ("whole", pa.bool_()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()),
    ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
    ("paths", _PATH), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int32())),
])
_PARTS_DDL = (
    "conv string, at int, seq long, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, "
    "first_role string, last_role string, cost long, audit string, repaired_sha256 string, paths array<struct<start:int,end:int,cost:long,audit:string>>, "
    "roles array<string>, texts array<string>, copies array<int>"
)
_LEGAL = {"su", "ua", "au"}


def _part(conv: str, at: int, seq: int, rows: list[Row], whole: bool) -> dict:
    """One row of ``_PARTS``: a finished conversation, or a segment with its cheapest ways and its rows."""
    initials = [row.role[:1] for row in rows]
    turns = {row.turn for row in rows} - {None}
    out = {
        "conv": conv, "at": at, "seq": seq, "whole": whole,
        "blank": sum(row.copies for row in rows if row.blank),
        "duplicate": sum(row.copies - (not row.duplicate) for row in rows if not row.blank),
        "truncated": sum(row.truncated for row in rows),
        # Copies of a row stand side by side, and no role may follow itself.
        "illegal": sum(row.copies - 1 for row in rows) + sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
        "turns": len(turns), "first_turn": min(turns, default=None), "last_turn": max(turns, default=None), "first_role": initials[0], "last_role": initials[-1],
        "cost": None, "audit": None, "repaired_sha256": None, "paths": [], "roles": [], "texts": [], "copies": [],
    }
    texts = [(row.role, row.text, row.copies) for row in rows]
    if whole:
        audits, ways = cheapest(rows, START)
        ways = with_insertions(audits, ways)
        ends = [ways[state] for state in (START, ASSISTANT) if state in ways]
        best = ends[0]
        for way in ends[1:]:
            if way.cost < best.cost or way.cost == best.cost and audits.less(way.node, best.node):
                best = way
        out["cost"], out["audit"] = best.cost, audits.text(best.node)
        out["repaired_sha256"] = hashlib.sha256("\n".join(lines(texts, out["audit"], START)).encode()).hexdigest()
    else:
        for start in range(4):
            audits, ways = cheapest(rows, start)
            out["paths"] += [{"start": start, "end": end, "cost": way.cost, "audit": audits.text(way.node)} for end, way in ways.items()]
        out["roles"], out["texts"], out["copies"] = (list(x) for x in zip(*texts))
    return out


def _parts_of(rows_each: int, bytes_each: int):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq = TaskContext.get().partitionId(), 0
        conv, held, size = None, [], 0
        #: The first conversation of a task may begin, and the last one end, in another task.
        inside = False
        ready: list[dict] = []

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(ready, _PARTS)
            ready.clear()
            return batch

        for batch in batches:
            for name, turn, role, text, copies, *flags in zip(*(batch[c].to_pylist() for c in ("conv", "turn", "role", "text", "copies", "blank", "duplicate", "truncated"))):
                if held and (name != conv or len(held) >= rows_each or size >= bytes_each):
                    done = inside and name != conv
                    ready.append(_part(conv, at, seq, held, done))
                    seq, held, size = seq + 1, [], 0
                    inside = name != conv
                    if len(ready) >= 256 or not done:
                        yield flushed()
                conv = name
                # Very many copies of a row are dealt to several segments; those after the first are duplicates or blank.
                blank, duplicate, truncated = flags
                while copies > rows_each:
                    ready.append(_part(conv, at, seq, [*held, Row(turn, role, text, rows_each, blank, duplicate, truncated)], False))
                    yield flushed()
                    seq, held, size, inside = seq + 1, [], 0, False
                    copies, duplicate, truncated = copies - rows_each, not blank, False
                held.append(Row(turn, role, text, copies, blank, duplicate, truncated))
                size += len(text)
        if held:
            ready.append(_part(conv, at, seq, held, False))
        if ready:
            yield flushed()

    return parts


# --- joining segments -----------------------------------------------------------------------------------------------
class _Joined(NamedTuple):
    """A way through the segments so far: total cost, and the last segment's part with the way before it."""

    cost: int
    before: _Joined | None
    segment: int
    start: int
    audit: str


def _is_less(a: _Joined, b: _Joined) -> bool:
    """Compares the strings of two ways through the same segments, from where they part."""
    tails: tuple[list[str], list[str]] = ([], [])
    while a is not b:
        tails[0].append(a.audit), tails[1].append(b.audit)
        a, b = a.before, b.before
    return "".join(reversed(tails[0])) < "".join(reversed(tails[1]))


class _Conversation:
    """Segments of one conversation, taken in order."""

    def __init__(self, conv: str):
        self.conv, self.keys, self.counts = conv, [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.first_turn = self.last_turn = self.last_role = None
        self.ways: dict[int, _Joined | None] = {START: None}

    def take(self, row: dict) -> None:
        for name in self.counts:
            self.counts[name] += row[name]
        if self.last_role is not None and self.last_role + row["first_role"] not in _LEGAL:
            self.counts["illegal"] += 1
        if row["turns"]:
            self.counts["turns"] -= self.last_turn is not None and self.last_turn == row["first_turn"]
            self.first_turn = row["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = row["last_turn"]
        self.last_role = row["last_role"]
        ways: dict[int, _Joined] = {}
        for path in row["paths"]:
            if path["start"] in self.ways:
                before = self.ways[path["start"]]
                new = _Joined((before.cost if before else 0) + path["cost"], before, len(self.keys), path["start"], path["audit"])
                held = ways.get(path["end"])
                if held is None or new.cost < held.cost or new.cost == held.cost and _is_less(new, held):
                    ways[path["end"]] = new
        self.ways = ways
        self.keys.append((row["at"], row["seq"]))

    def result(self) -> Iterator[dict]:
        ways = {}
        for state, more, end in ((START, "", START), (ASSISTANT, "", ASSISTANT), (USER, "I", ASSISTANT), (START, "II", ASSISTANT), (SYSTEM, "II", ASSISTANT)):
            if state in self.ways:
                way = self.ways[state]
                new = way._replace(cost=way.cost + INSERT * len(more), audit=way.audit + more)
                held = ways.get(end)
                if held is None or new.cost < held.cost or new.cost == held.cost and _is_less(new, held):
                    ways[end] = new
        best = min(ways.values(), key=lambda way: way.cost)
        for way in ways.values():
            if way.cost == best.cost and way is not best and _is_less(way, best):
                best = way
        slices, way = [], best
        while way is not None:
            slices.append(way)
            way = way.before
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.counts["turns"]
        whole = "".join(way.audit for way in reversed(slices))
        for way in reversed(slices):
            at, seq = self.keys[way.segment]
            first = way.segment == 0
            yield {
                "conv": self.conv, "at": at, "seq": seq, "start": way.start, "slice": way.audit, "first": first, "gaps": gaps, "cost": best.cost,
                "audit": whole if first else None, **{name: self.counts[name] for name in ("blank", "duplicate", "truncated", "illegal")},
            }


_JOINED = "conv string, at int, seq long, start int, slice string, first boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_JOINED_ARROW = pa.schema([
    ("conv", pa.string()), ("at", pa.int32()), ("seq", pa.int64()), ("start", pa.int32()), ("slice", pa.string()), ("first", pa.bool_()),
    *((name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()),
])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of conversation and place to the edits of each."""
    current: _Conversation | None = None
    for batch in batches:
        for row in batch.to_pylist():
            if current is None or current.conv != row["conv"]:
                if current is not None:
                    yield pa.RecordBatch.from_pylist(list(current.result()), _JOINED_ARROW)
                current = _Conversation(row["conv"])
            current.take(row)
    if current is not None:
        yield pa.RecordBatch.from_pylist(list(current.result()), _JOINED_ARROW)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired bytes of every segment in blocks, each line with a newline before it."""
    for batch in batches:
        for k in range(len(batch)):
            row = batch.slice(k, 1).to_pylist()[0]
            data = "".join(f"\n{line}" for line in lines(list(zip(row["roles"], row["texts"], row["copies"])), row["slice"], row["start"])).encode()
            cuts = range(0, max(len(data), 1), _BLOCK)
            yield pa.RecordBatch.from_pydict({
                "conv": pa.array([row["conv"]] * len(cuts)), "at": pa.array([row["at"]] * len(cuts), pa.int32()), "seq": pa.array([row["seq"]] * len(cuts), pa.int64()),
                "block": pa.array(range(len(cuts)), pa.int32()), "data": pa.array([data[lo : lo + _BLOCK] for lo in cuts], pa.binary()),
            })


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order to one SHA-256 a conversation; the first newline does not count."""
    conv, digest, empty = None, None, True

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"h_conv": pa.array([conv]), "repaired_sha256": pa.array([digest.hexdigest()])})

    for batch in batches:
        for name, data in zip(batch["conv"].to_pylist(), batch["data"].to_pylist()):
            if name != conv:
                if digest is not None:
                    yield done()
                conv, digest, empty = name, hashlib.sha256(), True
            digest.update(data[1:] if empty else data)
            empty = empty and not data
    if digest is not None:
        yield done()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(conversations: DataFrame, rows_each: int = SEGMENT_ROWS, bytes_each: int = SEGMENT_BYTES) -> DataFrame:
    """One row per distinct ``conv_id`` of ``conversations(conv_id, turn, role, text)``:
    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Nulls become one space before the damage; rows with a null ``conv_id`` are one conversation. Rows of one turn are
    ordered by role, then text (bytes), and equal rows stand side by side. A role's initial decides where it may stand
    and a kept row keeps its role as it is; an empty or unknown role can only be changed or go. A conversation without rows after the damage
    has zeros, an empty audit and the hash of the empty string. Further columns are ignored.

    ``rows_each`` and ``bytes_each`` bound a segment; they do not change results. A conversation's audit is one cell, and its
    hash is taken in one task from a stream of blocks; everything before works on segments.
    """
    prepare(conversations.sparkSession)
    rows = faults(stage(damaged(conversations), "repair-rows"))
    ranges = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    parts = stage(ranges.mapInArrow(_parts_of(rows_each, bytes_each), _PARTS_DDL), "repair-parts")
    segments = parts.where("NOT whole")
    paths = segments.drop("whole", "roles", "texts", "copies", "cost", "audit", "repaired_sha256")
    joined = stage(paths.repartition("conv").sortWithinPartitions("conv", "at", "seq").mapInArrow(_joined, _JOINED), "repair-joined")
    edited = segments.select("conv", "at", "seq", "roles", "texts", "copies").join(joined.select("conv", "at", "seq", "start", "slice"), ["conv", "at", "seq"])
    blocks = edited.mapInArrow(_blocks, "conv string, at int, seq long, block int, data binary")
    hashes = blocks.repartition("conv").sortWithinPartitions("conv", "at", "seq", "block").mapInArrow(_hashes, "h_conv string, repaired_sha256 string")
    split = joined.where("first").join(hashes, F.col("conv") == F.col("h_conv"))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    found = parts.where("whole").select("conv", gaps, *_COUNTS[1:], "audit", "repaired_sha256").unionByName(split.select("conv", *_COUNTS, "audit", "repaired_sha256"))
    ids = conversations.select(F.col("conv_id")).distinct()
    named = ids.join(found, F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")) == F.col("conv"), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return named.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def _sql() -> str:
    """The same by a recursive query that carries whole strings: one row per conversation and step."""
    way = "STRUCT(c BIGINT, a VARCHAR, l VARCHAR)"

    def step(state: str, cost: str, letter: str, line: str = "''") -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN CAST({{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'l': {state}.l || {line}}} AS {way}) END"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def only(condition: str, option: str) -> str:
        return f"CASE WHEN {condition} THEN {option} END"

    user, assistant, own = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text"
    to_user = [least(*(only("NOT bad AND i0 = 'u'", step(s, "trunc", "K", own)) for s in ("p0", "p1", "p3"))), least(*(only("NOT bad AND i0 <> 'u'", step(s, "2 + trunc", "R", f"{user} || text")) for s in ("p0", "p1", "p3")))]
    to_assistant = [only("NOT bad AND i0 = 'a'", step("p2", "trunc", "K", own)), only("NOT bad AND i0 <> 'a'", step("p2", "2 + trunc", "R", f"{assistant} || text"))]

    def relaxed(rows: str) -> str:
        return f"""SELECT *, s0 AS p0, s1 AS p1, p2, {least("s3", step("p2", "2", "I", assistant))} AS p3
        FROM (SELECT *, {least("s2", step("s0", "2", "I", user), step("s1", "2", "I", user), step("s3", "2", "I", user))} AS p2 FROM {rows})"""


    return f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
keys AS (SELECT DISTINCT key FROM named),
crcs AS (
  SELECT key, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(key, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda v, x: CASE WHEN x >= 0 THEN xor(v, x) WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM keys),
hit AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM named JOIN crcs USING (key)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank FROM hit),
faulty AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate FROM placed),
rows_ AS (
  SELECT *, blank OR duplicate AS bad, CASE WHEN NOT blank AND NOT duplicate AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 1 ELSE 0 END AS trunc, left(role, 1) AS i0,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM faulty),
totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, sum(trunc) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i0 NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows_ GROUP BY conv_id),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': '', 'l': ''}} AS {way}) AS s0, CAST(NULL AS {way}) AS s1, CAST(NULL AS {way}) AS s2, CAST(NULL AS {way}) AS s3 FROM totals
  UNION ALL
  SELECT conv_id, i + 1, {step("p0", "3", "D")}, {least(step("p1", "3", "D"), only("NOT bad AND i0 = 's'", step("p0", "trunc", "K", own)))},
    {least(step("p2", "3", "D"), *to_user)}, {least(step("p3", "3", "D"), *to_assistant)}
  FROM ({relaxed("(SELECT dp.*, role, text, i0, bad, trunc FROM dp JOIN rows_ ON rows_.conv_id IS NOT DISTINCT FROM dp.conv_id AND rows_.pos = dp.i + 1)")})),
ends AS (
  SELECT conv_id, gaps, blank, duplicate, truncated, illegal, {least("p0", "p3")} AS best
  FROM ({relaxed("(SELECT dp.*, gaps, blank, duplicate, truncated, illegal FROM dp JOIN totals ON totals.conv_id IS NOT DISTINCT FROM dp.conv_id AND totals.n = dp.i)")}))
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.l, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


SQL = _sql()
