import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hostwarden.llm import substring_dedup, support, textbytes
from hostwarden.llm.support import bit_table, maybe_in, positions


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_words_of_a_slice_are_hashed_in_parts(monkeypatch):
    text = "some words that stand here " * 40_000
    piece = next(textbytes.text_slices(pa.array([text])))
    monkeypatch.setattr(textbytes, "_powers", {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)})
    assert peak(lambda: textbytes.words(piece)) < 32 << 20
    w = textbytes.words(piece)
    assert len(w.hash) == 200_000 and len(set(w.hash.tolist())) == 5 and (w.hash[:5] == w.hash[-5:]).all()


def test_words_as_long_as_several_parts():
    long = "x" * (3 * textbytes._HASHED_BYTES + 7)
    w = textbytes.words(next(textbytes.text_slices(pa.array([f"a {long} b", f"{long} a"]), 1 << 30)))
    assert w.doc.tolist() == [0, 0, 0, 1, 1]
    assert w.hash[0] == w.hash[4] and w.hash[1] == w.hash[3] and len(set(w.hash.tolist())) == 3


def test_bits_are_set_without_a_flag_each():
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 100_000)
    at, table = np.concatenate(positions(keys, 1 << 26)), np.zeros(1 << 20, np.uint64)
    assert peak(lambda: support._set_bits(table, at)) < 32 << 20
    assert np.array_equal(np.flatnonzero(np.unpackbits(table.view(np.uint8), bitorder="little")), np.unique(at))


@pytest.mark.parametrize("bits", [64, 1 << 16, 1 << 23])
def test_bit_table_over_several_tasks(spark, bits):
    rows = spark.range(0, 3000, 1, 7).select(F.when(F.col("id") % 10 > 0, F.xxhash64("id")).alias("key"))
    keys = np.array([r["key"] for r in rows.collect() if r["key"] is not None])
    wanted = np.zeros(bits, bool)
    for at in positions(keys, bits):
        wanted[at] = True
    table = bit_table(rows, "key", bits)
    assert np.array_equal(table, wanted) and maybe_in(table, keys).all()
    assert not bit_table(rows.where("false"), "key", bits).any()


def test_passages_leave_no_word_lists_in_the_shared_folder(spark, texts, tmp_path, monkeypatch):
    """Seeds and word lists, the widest tables, are emptied once they are read."""
    monkeypatch.setattr("hostwarden.session.shared_dir", lambda _: str(tmp_path))
    rng = np.random.default_rng(2)
    passage = [f"w{x}" for x in rng.integers(0, 10**6, 80)]
    rows = [(k, " ".join([*(f"v{x}" for x in rng.integers(0, 10**6, 30)), *passage])) for k in range(3)]
    assert substring_dedup.repeated_passages(texts(rows)).count() == 2
    for name in ("words", "seeds", "sources"):
        written = list(tmp_path.glob(f"passage-{name}-*"))
        assert written and all(spark.read.parquet(str(p)).count() == 0 for p in written), name
