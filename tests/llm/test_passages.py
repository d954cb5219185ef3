import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from hostwarden.llm import decontamination, substring_dedup, textbytes
from tests.llm.conftest import plain_words


def vocabulary(seed):
    rng = random.Random(seed)
    return lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_fuzzy_passage_is_found_and_cut(texts):
    new = vocabulary(1)
    passage = new(60)
    changed = list(passage)
    changed[20], changed[41] = "other", "words"
    del changed[30]
    rows = [(1, " ".join(new(80) + passage + new(30))), (2, " ".join(new(10) + changed + new(50))), (3, " ".join(new(100))), (4, None), (5, ""), (6, "short text"), (None, " ".join(passage))]
    docs = texts(rows)
    found = substring_dedup.repeated_passages(docs).collect()
    assert [(r["doc_id"], r["source_id"], r["start_word"], r["end_word"], r["source_start"], r["source_end"]) for r in found] == [(2, 1, 10, 69, 80, 140)]
    kept = {r["doc_id"]: r for r in substring_dedup.remove_passages(docs, substring_dedup.repeated_passages(docs)).collect()}
    assert plain_words(kept[2]["text"]) == plain_words(rows[1][1])[:10] + plain_words(rows[1][1])[69:]
    assert kept[2]["n_chars"] == len(kept[2]["text"]) and kept[1]["text"] == rows[0][1] and kept[3]["text"] == rows[2][1] and len(kept) == 7


def test_covers_every_repeated_window(texts):
    """Texts stitched from pieces of others, copies, and passages twice in one text, against all 51-word windows."""
    rng, new = random.Random(4), vocabulary(2)
    pool = [new(rng.choice((30, 55, 90))) for _ in range(12)]
    rows = [(k, " ".join(sum((rng.choice(pool) if rng.random() < 0.5 else new(25) for _ in range(5)), []))) for k in range(60)]
    rows += [(100, rows[7][1]), (101, rows[7][1])]
    spans = {}
    for r in substring_dedup.repeated_passages(texts(rows)).collect():
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    first = {}
    for i, t in rows:
        w = plain_words(t)
        windows = [tuple(w[k : k + 51]) for k in range(len(w) - 50)]
        for k, x in enumerate(windows):
            if x in first and first[x] != i:
                bare = [q for q in range(k, k + 51) if not any(s <= q < e for s, e in spans.get(i, ()))]
                assert len(bare) <= 11, (i, k, first[x])
        for x in windows:
            first.setdefault(x, i)


def covered(texts, rows):
    spans = {}
    for r in substring_dedup.repeated_passages(texts(rows)).collect():
        spans.setdefault((r["doc_id"], r["source_id"]), set()).update(range(r["start_word"], r["end_word"]))
    return spans


def test_fuzzy_passage_whose_runs_stand_in_earlier_texts(texts):
    """Every equal run of 10 and 11 also stands in an earlier text that is no source; in the second case in very many."""
    new = vocabulary(11)
    for many in (1, 90):
        passage = new(60)
        changed = [f"other{k}" if k in (19, 39) else w for k, w in enumerate(passage)]
        rows = [(100 * part + k, " ".join(new(40) + passage[20 * part : 20 * part + 19] + new(40))) for part in range(3) for k in range(1, many + 1)]
        rows += [(65535, " ".join(new(30) + passage + new(30))), (65536, " ".join(new(20) + changed + new(20)))]
        spans = covered(texts, rows)
        assert set(spans) == {(65536, 65535)} and len(spans[65536, 65535] & set(range(20, 80))) >= 56


def test_fuzzy_passage_of_pieces_that_many_texts_hold(texts):
    """Five pieces of 13 words, two of them in 280 texts before and 280 texts between the two that have them all."""
    rng, new = random.Random(14), vocabulary(14)
    pieces = [new(13) for _ in range(5)]
    whole = sum(pieces, [])
    changed = [f"other{k}" if k in (19, 45) else w for k, w in enumerate(whole)]

    def two(k):
        at = k % 4
        return k, " ".join(new(20) + pieces[at] + pieces[at + 1] + new(20))

    rows = [*map(two, range(280)), (280, " ".join(new(20) + whole + new(20))), *map(two, range(281, 561)), (561, " ".join(new(20) + changed + new(20)))]
    rng.shuffle(rows)
    spans = covered(texts, rows)
    assert set(spans) == {(561, 280)} and len(spans[561, 280] & set(range(20, 85))) >= 61


def test_shared_runs_against_a_plain_count(spark, texts):
    """Runs of four words that several rows hold, however the rows are dealt; the earliest class of ids and its holders."""
    new = vocabulary(15)
    pool = [new(6) for _ in range(20)]
    rng = random.Random(15)
    rows = [(k * 7, " ".join(sum((rng.choice(pool) for _ in range(rng.randrange(0, 6))), new(3)))) for k in range(300)] + [(2100, None), (2101, ""), (2102, "a b c")]
    holders = {}
    for i, t in rows:
        w = plain_words(t)
        for run in {tuple(w[k : k + 4]) for k in range(len(w) - 3)}:
            holders.setdefault(run, []).append(i)
    width, wanted = 2103, []
    for ids in holders.values():
        group = sorted(min(255, int(i / width * 256)) for i in ids)
        if len(ids) > 1:
            wanted.append((min(len(ids), 255), group[0], group.count(group[0]) > 1))
    for parts in (1, 9):
        docs = texts(rows).repartition(parts).select("doc_id", "text")
        blocks = docs.mapInArrow(substring_dedup._run_blocks(6, 0, width), "bucket int, runs binary, n binary, least binary, several binary")
        got = blocks.repartition(8, "bucket").mapInArrow(substring_dedup._shared_runs, "seed long, n long, least int, several boolean").collect()
        assert sorted((min(r["n"], 255), r["least"], r["several"]) for r in got) == sorted(wanted)


def test_recall_of_substituted_passages(texts):
    """Passages with one word in 20 to one word in 5 substituted, regularly and at random places."""
    rng, new = random.Random(12), vocabulary(12)
    rows, wanted = [], {}
    for n in (40, 50, 60, 100):
        for every in (5, 6, 8, 10, 20):
            for regular in (True, False):
                i, passage = len(rows), new(n)
                at = set(range(every // 2, n, every)) if regular else set(rng.sample(range(n), n // every))
                rows.append((i, " ".join(new(60) + passage + new(60))))
                rows.append((i + 1, " ".join(new(60) + [f"x{k}" if k in at else w for k, w in enumerate(passage)] + new(60))))
                wanted[i + 1, i] = n
    spans = covered(texts, rows)
    lost = [(pair, n) for pair, n in wanted.items() if len(spans.get(pair, set()) & set(range(60, 60 + n))) < 0.8 * n]
    assert not lost and set(spans) == set(wanted), lost


def test_clean_texts_and_empty_tables(texts):
    new = vocabulary(3)
    line = " ".join(new(12))
    docs = texts([(k, line + "\n" + " ".join(new(70))) for k in range(30)])
    assert substring_dedup.repeated_passages(docs).count() == 0
    assert substring_dedup.repeated_passages(texts([])).count() == 0
    assert substring_dedup.remove_passages(docs, substring_dedup.repeated_passages(docs)).count() == 30


def test_text_that_is_a_passage_goes(texts):
    text = " ".join(vocabulary(5)(70))
    docs = texts([(1, text), (2, text), (2, text)])
    assert [r["doc_id"] for r in substring_dedup.remove_passages(docs, substring_dedup.repeated_passages(docs)).collect()] == [1]


def test_winnow_guarantee():
    h = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    at = set(substring_dedup.winnow(h, 12).tolist())
    assert at == {k + int(h[k : k + 12].argmin()) for k in range(len(h) - 11)}


def test_chain_is_best():
    """Fenwick chaining against the quadratic recurrence."""
    rng = random.Random(9)
    for _ in range(50):
        runs = sorted({(rng.randrange(200), rng.randrange(200), rng.randrange(6, 20)) for _ in range(25)})
        best = []
        for r, (i, j, n) in enumerate(runs):
            options = [best[p] - 0.5 * (i - a - m + j - b - m) for p, (a, b, m) in enumerate(runs[:r]) if a + m - 5 <= i and b + m - 5 <= j]
            best.append(n + max([0, *options]))
        top = substring_dedup.chains(runs)[0]
        score = sum(n for _, _, n in top) - sum(0.5 * (y[0] - x[0] - x[2] + y[1] - x[1] - x[2]) for x, y in zip(top, top[1:]))
        assert abs(score - max(best)) < 1e-9


def test_anchors_against_plain_runs():
    """Common runs with and without one of ``LONG_K`` words, short ones that recur, against a search without shortcuts."""
    rng = np.random.default_rng(5)
    for same in (0, 39, 40, 41, 90):
        a, b = (rng.integers(0, 10**6, 200).astype(np.int32) for _ in "ab")
        a[70 : 70 + same] = b[50 : 50 + same]
        a[5:9] = a[30:34] = b[180:184] = b[3:7]
        met = {(i, j) for i in range(len(a) - 3) for j in range(len(b) - 3) if np.array_equal(a[i : i + 4], b[j : j + 4])}
        got = {(i + x, j + x) for i, j, n in substring_dedup.anchors(a, b, 4) for x in range(n - 3)}
        assert got <= met and {(i, j) for i, j in met if i - j == 20} <= got and (5, 3) in got and (30, 180) in got
    assert substring_dedup.anchors(a[:3], b, 4) == []


def test_ids_far_apart(texts):
    """Ids that leave no room for a position beside them in 63 bits; the earliest holder has the passage twice."""
    new = vocabulary(16)
    passage = new(60)
    first = " ".join(new(10) + passage + new(20) + passage)
    rows = [(-(1 << 61), first), (1 << 61, " ".join(new(30) + passage)), (5, " ".join(new(70)))]
    found = substring_dedup.repeated_passages(texts(rows)).collect()
    assert {(r["doc_id"], r["source_id"], r["start_word"], r["end_word"]) for r in found} == {(1 << 61, -(1 << 61), 30, 90)}


def leaks(spark, texts, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string, seed int")
    return sorted((r["doc_id"], r["item_id"], r["equal_words"], r["start_word"]) for r in decontamination.contaminated(texts(rows), bench).collect())


def test_decontamination(spark, texts):
    new = vocabulary(7)
    item, short = new(40), new(6)
    spoiled = [("x" if k % 7 == 3 else w) for k, w in enumerate(item)]
    rows = [
        (1, " ".join(new(50) + item + new(9))), (2, " ".join(new(5) + spoiled)), (3, " ".join(new(60))), (4, " ".join(item[:12] + new(50))), (5, " ".join(item[10:30])),
        (6, None), (7, ""), (8, " ".join(new(3) + [w.upper() for w in short])), (1, " ".join(new(50) + item)), (None, " ".join(item)), (9, " ".join(["say"] * 3000)),
    ]
    items = [(10, " ".join(item), 0), (11, " ".join(short), 0), (12, "two words", 0), (13, None, 0), (14, "", 0), (10, " ".join(item), 0)]
    assert leaks(spark, texts, rows, items) == [(1, 10, 40, 50), (2, 10, 30, 9), (5, 10, 20, 0), (8, 11, 6, 3)]
    assert leaks(spark, texts, [], items) == [] and leaks(spark, texts, rows, []) == []


def test_decontamination_keeps_other_rows(spark, texts):
    item = vocabulary(8)(30)
    docs = texts([(1, " ".join(item)), (2, "fine"), (None, "fine")])
    found = decontamination.contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert sorted((r["doc_id"] for r in decontamination.clean(docs, found).collect()), key=str) == [2, None]


def test_decontamination_tolerates_substitutions(spark, texts):
    """Whole items with words substituted at any places, against the stated rule; an item with too many changed does not match."""
    rng, new = random.Random(13), vocabulary(13)
    rows, items, wanted = [], [], set()
    cases = [(20, (4, 6, 14)), (6, (2,)), (10, (3, 7)), (20, range(2, 20, 3)), (12, (1, 5, 9)), (5, (2,))]
    cases += [(n, rng.sample(range(n), c)) for n, c in ((20, 3), (18, 3), (16, 2), (24, 4), (24, 5), (30, 6), (13, 2), (8, 1), (17, 3)) for _ in range(20)]
    for k, (n, changed) in enumerate(cases):
        item = new(n)
        items.append((k, " ".join(item), 0))
        rows.append((k, " ".join(new(15) + [f"x{j}" if j in changed else w for j, w in enumerate(item)] + new(15))))
        same = [j not in set(changed) for j in range(n)]
        parts = [same[s:e] for s in range(n) for e in range(s + 1, n + 1)]
        if any(sum(p) >= min(13, max(5, 0.8 * n)) and 4 * (len(p) - sum(p)) < len(p) for p in parts):
            wanted.add((k, k))
    assert len(wanted) > 150
    assert {(doc, item) for doc, item, *_ in leaks(spark, texts, rows, items)} == wanted


def test_texts_are_read_once(spark, texts):
    rng, new = random.Random(17), vocabulary(17)
    pool = [new(60) for _ in range(4)]
    rows = [(k, " ".join(new(20) + rng.choice(pool) + new(20))) for k in range(40)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    docs = texts(rows, False).select("doc_id", "text").mapInArrow(counted, "doc_id long, text string")
    assert substring_dedup.repeated_passages(docs).count() >= 36 and read.value == 40


def test_shared_runs_of_blocks_against_a_plain_search(monkeypatch):
    """Texts in blocks of several rows, one of them read in two parts: runs with their places and flags, and seeds."""
    monkeypatch.setattr(substring_dedup, "_BLOCK_WORDS", 400)
    monkeypatch.setattr(substring_dedup, "_ROW_WORDS", 70)
    monkeypatch.setattr(substring_dedup, "_MANY", 15)
    monkeypatch.setattr(substring_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 2)))
    rng, new = random.Random(18), vocabulary(18)
    pool = [new(rng.choice((5, 9, 45))) for _ in range(15)]
    rows = [(k * 3, " ".join(sum((rng.choice(pool) for _ in range(rng.randrange(0, 5))), new(3)))) for k in range(120)] + [(400, ""), (401, "a b c"), (402, " ".join(new(90)))]
    texts = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows]), "text": pa.array([t for _, t in rows])})
    stored = list(substring_dedup._text_blocks(texts[k : k + 25] for k in range(0, len(rows), 25)))
    numbers = [b["block"][0].as_py() for b in stored]
    assert len(stored) > len(set(numbers)) > 3 and sum(b["part"][0].as_py() == 0 for b in stored) == len(set(numbers))
    inside = next(k for k in range(1, len(numbers)) if numbers[k] == numbers[k - 1])
    width = 403
    runs = [x for part in (stored[:inside], stored[inside:]) for x in substring_dedup._run_blocks(6, 0, width, True)(iter(part))]
    shared = list(substring_dedup._shared_of_blocks(iter(runs)))
    both = [pa.RecordBatch.from_pydict({c: x[c] if c in x.schema.names else pa.nulls(len(x)) for c in ("block", "bucket", "part", "runs", "least", "flags", *substring_dedup._WORDS[2:])}) for x in (*stored, *shared)]
    marked = list(substring_dedup._marked(6, 0, width)(iter(both)))

    held = [(i, plain_words(t)) for i, t in rows]
    holders = {}
    for i, w in held:
        for run in {tuple(w[k : k + 4]) for k in range(len(w) - 3)}:
            holders.setdefault(run, []).append(i)
    group = lambda i: int(i / width * 256)
    wanted = []
    for i, w in held:
        at = {}
        for k in range(len(w) - 3):
            at.setdefault(tuple(w[k : k + 4]), []).append(k)
        for run, places in at.items():
            if len(ids := holders[run]) > 1:
                least = min(map(group, ids))
                earlier = group(i) > least or sum(group(x) == least for x in ids) > 1
                wanted.append((i, places[0], places[-1], earlier + 2 * (len(ids) > 15)))
    got = [(int(ids[d]), int(lo), int(lo + span), int(f)) for ids, *columns in substring_dedup._parts(iter(marked), "run", substring_dedup._FOUND[1]) for _, d, lo, span, f in zip(*columns)]
    assert sorted(got) == sorted(wanted) and {f for *_, f in got} >= {1, 3}
    for name, k in (("short", substring_dedup.K), ("long", substring_dedup.LONG_K)):
        seeds = [(int(ids[d]), int(at)) for ids, *columns in substring_dedup._parts(iter(marked), name, substring_dedup._FOUND[0]) for _, d, at in zip(*columns)]
        words = dict(held)
        assert seeds and all(len(holders[tuple(words[i][x : x + 4])]) > 1 for i, at in seeds for x in range(at, at + k - 3))


def test_hashes_of_long_runs_are_those_of_short_steps():
    h = np.random.default_rng(6).integers(0, 1 << 64, 5000, dtype=np.uint64)
    for n in (5, 6, 40):
        total = [0] * (len(h) - n + 1)
        for j in range(n):
            total = [(t + n * (j == 0)) * 0xD6E8FEB86659FD93 + int(x) & 0xFFFFFFFFFFFFFFFF for t, x in zip(total, h[j:])]
        assert textbytes.run_hashes(h, n).tolist() == total
