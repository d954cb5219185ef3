import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from hostwarden.llm import conversation_repair as repair

OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def plain_programme(rows):
    """Cheapest (cost, audit, lines) with whole strings; ``rows`` of (role, text, bad, truncated)."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {2: "user", 3: "assistant"}

    def inserted(ways):
        ways, changed = dict(ways), True
        while changed:
            changed = False
            for state, (cost, audit, text) in list(ways.items()):
                for to in after[state].values():
                    if to > 1:
                        new = (cost + 2, audit + "I", (*text, f"{names[to]}:"))
                        if to not in ways or new < ways[to]:
                            ways[to], changed = new, True
        return ways

    ways = {0: (0, "", ())}
    for role, text, bad, truncated in rows:
        found = {}
        for state, (cost, audit, kept) in inserted(ways).items():
            options = [(state, (cost + 3, audit + "D", kept))]
            if not bad:
                for initial, to in after[state].items():
                    if role[:1] == initial:
                        options.append((to, (cost + truncated, audit + "K", (*kept, f"{role}:{text}"))))
                    if to > 1:
                        options.append((to, (cost + 2 + truncated, audit + "R", (*kept, f"{names[to]}:{text}"))))
            for to, way in options:
                found[to] = min(found.get(to, way), way)
        ways = found
    ways = inserted(ways)
    return min(ways[state] for state in (0, 3) if state in ways)


def every_edit(rows, most):
    """The same by trying all strings of edits up to a length."""
    best = None
    names = {"u": "user", "a": "assistant"}
    for length in range(most + 1):
        for audit in itertools.product("DIKR", repeat=length):
            if sum(c != "I" for c in audit) != len(rows):
                continue
            cost, at, kept = 0, 0, []
            for edit in audit:
                want = "a" if kept and kept[-1][0] == "u" else "u"
                if edit == "I":
                    kept.append((want, f"{names[want]}:"))
                    cost += 2
                    continue
                role, text, bad, truncated = rows[at]
                at += 1
                if edit == "D":
                    cost += 3
                elif bad:
                    break
                else:
                    cost += truncated + 2 * (edit == "R")
                    kept.append((role[:1], f"{role}:{text}") if edit == "K" else (want, f"{names[want]}:{text}"))
            else:
                if re.fullmatch("(s?(ua)+)?", "".join(k for k, _ in kept)):
                    way = (cost, "".join(audit), tuple(line for _, line in kept))
                    best = way if best is None else min(best, way)
    return best


def plain_repair(rows):
    out = []
    hit = damage(rows)
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in hit if r[0] == conv]
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for turn, role, text in own:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, text = plain_programme(marked)
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def random_rows(rng, convs, most, conv_of=lambda k: k):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "uncle", "User"]
    texts = ["Yes.", "No", "Why?", " ", "", None, " ", "a!\n", "x\ty", "Ä.", "ok\x0b", "end .\r\n"]
    rows = []
    for k in range(convs):
        for turn in range(rng.randrange(most)):
            rows.append((conv_of(k), rng.choice([turn, turn, turn, turn, None, turn + 3]), rng.choice(roles[: rng.choice([3, 5, 10])]), rng.choice(texts)))
    return rows + rows[:7]


SCHEMA = "conv_id long, turn long, role string, text string, seq int, cost string, whole boolean, at int"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, "x", True, 2) for r in rows], SCHEMA).repartition(parts)


def collected(df):
    assert df.columns == OUT
    return sorted(map(tuple, df.collect()), key=repr)


def test_plain_programme_is_the_cheapest_of_all_edits():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice("xy"), rng.random() < 0.2, int(rng.random() < 0.3)) for _ in range(rng.randrange(4))]
        assert plain_programme(rows) == every_edit(rows, 2 * len(rows) + 2)


@pytest.mark.parametrize("prime", [(1 << 61) - 1, 3])
def test_audits_compare_like_strings(prime):
    """Also with a hash that collides all the time."""
    rng = random.Random(prime % 1000)
    audits = repair.Audits(base=2, prime=prime)
    nodes, texts = [0], [""]
    for _ in range(400):
        k = rng.randrange(len(nodes)) if rng.random() < 0.3 else len(nodes) - 1
        letter = rng.choice("DDDDI")
        nodes.append(audits.add(nodes[k], letter)), texts.append(texts[k] + letter)
    for _ in range(4000):
        i, j = rng.randrange(len(nodes)), rng.randrange(len(nodes))
        assert audits.text(nodes[i]) == texts[i]
        assert audits.less(nodes[i], nodes[j]) == (texts[i] < texts[j])


def test_states_left_out_are_never_needed():
    rng = random.Random(8)
    for _ in range(300):
        rows = [repair.Row(k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice("xyz"), rng.choice([1, 1, 1, 3]), rng.random() < 0.2, False, rng.random() < 0.3) for k in range(rng.randrange(1, 14))]
        flat = [(r.role, r.text, r.blank or k > 0, int(r.truncated and not r.blank and k == 0)) for r in rows for k in range(r.copies)]
        rows = [r._replace(truncated=r.truncated and not r.blank) for r in rows]
        part = repair._part("c", 0, 0, rows, True)
        cost, audit, lines = plain_programme(flat)
        assert (part["cost"], part["audit"], part["repaired_sha256"]) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_against_brute_force(spark):
    rows = random_rows(random.Random(1), 150, 14, lambda k: None if k == 17 else k)
    assert collected(repair.repair(frame(spark, rows))) == plain_repair(rows)


def test_segments_do_not_change_results(spark):
    rng = random.Random(2)
    rows = random_rows(rng, 12, 60) + [(500, t, rng.choice(["user", "assistant"]), f"{t}.") for t in range(700)]
    rows += [(501, None, "user", "same.")] * 40 + [(502, t, "user", "same.") for t in range(90)] + [(503, 5, "assistant", f"{'y' * 90}{k}") for k in range(50)]
    want = plain_repair(rows)
    for rows_each, bytes_each in ((1, 100), (7, 1 << 20), (4096, 60)):
        assert collected(repair.repair(frame(spark, rows, 3), rows_each, bytes_each)) == want


def test_very_long_text(spark):
    text = "word " * 60_000
    rows = [(1, 0, "user", text + "."), (1, 1, "assistant", text), (1, 2, "user", text + "."), (2, 0, "system", "x.")]
    assert collected(repair.repair(frame(spark, rows))) == plain_repair(rows)


def test_empty_and_dropped(spark):
    assert repair.repair(frame(spark, [])).collect() == []
    turn = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    got = collected(repair.repair(frame(spark, [(9, turn, "user", "gone.")])))
    assert got == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_sql_against_brute_force(spark):
    import pandas as pd

    rows = random_rows(random.Random(3), 60, 9, lambda k: None if k == 5 else k)
    con = duckdb.connect()
    con.register("frame", pd.DataFrame({"conv_id": pd.array([r[0] for r in rows], "Int64"), "turn": pd.array([r[1] for r in rows], "Int64"), "role": [r[2] for r in rows], "text": [r[3] for r in rows]}))
    con.execute("CREATE VIEW conversations AS SELECT * FROM frame")
    found = con.execute(repair.SQL)
    assert [d[0] for d in found.description] == OUT
    assert sorted(found.fetchall(), key=repr) == plain_repair(rows)
