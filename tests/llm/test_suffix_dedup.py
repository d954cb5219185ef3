import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from hostwarden.llm import suffix_dedup


def plain(rows, width):
    """All windows of all texts in a dictionary."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + width] for _, b in texts for p in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def collected(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in df.collect()), key=repr)


def pieces(rng, count, alphabet="abcdeé \n"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(count)]


@pytest.mark.parametrize("width", [16, 17, 40])
def test_against_all_windows(spark, texts, width):
    rng = random.Random(width)
    common = pieces(rng, 12)
    rows = [(k, "".join(rng.choice(common) if rng.random() < 0.6 else pieces(rng, 1)[0] for _ in range(rng.randrange(8)))) for k in range(120)]
    # Periods, an immediate repeat, a window that only overlaps itself, copies, nulls and repeated rows.
    rows += [(200, "x" * 100), (201, "x" * width), (202, "ab" * 50), (203, "abc" * 30 + "d"), (204, "q" * (width - 1)), (205, "Q" * (width + 1)), (206, "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJ" * 2)]
    rows += [(207, None), (208, ""), (209, " \t\n"), rows[3], rows[3], (210, rows[5][1]), (None, rows[6][1]), (None, "only once: " + "%".join(map(str, range(40))))]
    assert collected(suffix_dedup.without_repeats(texts(rows), width, with_text=True)) == plain(rows, width)


def test_near_copies(spark, texts):
    """One changed letter every few hundred bytes, at other places in every copy, and shared beginnings and ends."""
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = []
    for k in range(40):
        b = list(base[rng.randrange(500) : 3000 - rng.randrange(500)])
        for _ in range(rng.randrange(8)):
            b[rng.randrange(len(b))] = rng.choice("XYZ")
        rows.append((k, "".join(b) if k % 3 else "".join(b) + "".join(rng.choice("uvw") for _ in range(700))))
    assert collected(suffix_dedup.without_repeats(texts(rows), 400, with_text=True)) == plain(rows, 400)


def test_very_long_text_and_pieces(spark, texts, monkeypatch):
    """A text of several blocks with copies across the cuts; a long run of one character is one row, not one a byte."""
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 5000)
    rng = np.random.default_rng(1)
    data = "".join(map(chr, rng.integers(97, 105, 40_000)))
    rows = [(1, data), (2, data[4000:6200] + "-" + data[14_800:15_400]), (3, "z" * 30_000), (4, data[39_500:])]

    def pieced(d, slices=None):
        import pyarrow as pa

        for b, row, first, stop, origin in suffix_dedup._pieces(pa.array([t for _, t in d]), 400):
            for start, n, far, suffix, cell, times in zip(*suffix_dedup.cells(b, first, stop, 400, 201)):
                yield start - origin[0] if len(origin) == 1 else start, n, times

    covered = sorted(x for start, n, times in pieced([rows[0]]) for x in range(start, start + n * times))
    assert covered == list(range(40_000 - 399))
    assert len(list(pieced([rows[2]]))) < 40
    assert collected(suffix_dedup.without_repeats(texts(rows), 400, with_text=True)) == plain(rows, 400)


def test_sampled_positions_are_the_same_in_equal_windows():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    named = suffix_dedup._named_positions(data, 30)
    assert len(named) == 5000 - 29 and (named >= np.arange(len(named))).all() and (named - np.arange(len(named)) < 30).all()
    places = {}
    for p in range(len(named) - 20):
        key = data[p : p + 37].tobytes()
        assert places.setdefault(key, named[p] - p) == named[p] - p
    texts_ = rng.integers(0, 255, 1 << 16).astype(np.uint8)
    assert len(np.unique(suffix_dedup._named_positions(texts_, 201))) < 2.2 * len(texts_) / 201


def test_empty(spark, texts):
    assert suffix_dedup.without_repeats(texts([])).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.without_repeats(texts([]), 15)


def test_sql_against_all_windows():
    rng = random.Random(3)
    base = "".join(rng.choice("abé ") for _ in range(1500))
    rows = [(1, base), (2, base[300:900]), (3, "x" * 402), (4, None), (5, "short"), (5, base[1000:] + "!"), (6, "y" * 400)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = con.execute(suffix_dedup.SQL).fetchall()
    assert sorted(got, key=repr) == sorted((r[:5] for r in plain(rows, 400)), key=repr)
