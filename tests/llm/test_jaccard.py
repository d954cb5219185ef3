import random

from hostwarden.llm import ngram_jaccard
from hostwarden.llm.support import connected
from tests.llm.conftest import components, shingles


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)]
    ids = {i for i, _ in rows if i is not None}
    comp = components(ids, links)
    return sorted(((i, len(s), comp.get(i)) for i, s in sets), key=repr)


def corpus(seed=3, base=40):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    common = " ".join(word() for _ in range(40))
    rows, k = [], 0
    for _ in range(base):
        text = [word() for _ in range(rng.choice((8, 12, 60, 150)))] + (common.split() if rng.random() < 0.4 else [])
        for _ in range(rng.choice((1, 1, 2, 6))):
            copy = list(text)
            for _ in range(rng.choice((0, 1, 2, 5))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((k, " ".join(copy)))
            k += 1
    return rows


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def test_matches_brute_force(texts):
    rows = corpus() + [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "one\ttwo"), (907, "a b c"), (907, "a b c"), (None, "a b c"), (908, "long " * 4000)]
    for n, percent in ((3, 90), (5, 80)):
        assert result(ngram_jaccard.similarity_classes(texts(rows), n, percent)) == brute(rows, n, percent)


def test_large_group_of_near_copies(texts):
    rng = random.Random(1)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(300):
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    assert result(ngram_jaccard.similarity_classes(texts(rows))) == brute(rows, 3, 90)


def test_rows_sharing_an_id_are_one_document(texts):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    got = result(ngram_jaccard.similarity_classes(texts([(5, a), (5, b), (3, a), (9, b), (7, "else")])))
    assert got == sorted([(5, 28, 3), (5, 28, 3), (3, 28, 3), (9, 28, 3), (7, 1, 7)], key=repr)


def test_empty_table(texts):
    assert ngram_jaccard.similarity_classes(texts([])).count() == 0
    assert ngram_jaccard.one_of_each(texts([])).count() == 0


def test_one_of_each_keeps_all_columns(texts):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "a b c d e f")]
    got = ngram_jaccard.one_of_each(texts(rows))
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and sorted((r["doc_id"] for r in got.collect()), key=str) == [1, 3, None]


def test_classes_of_chains_stars_and_random_links_in_small_parts(spark):
    rng = random.Random(7)
    chain = rng.sample(range(1000), 60)
    star = [(2000, k) for k in range(2001, 2080)]
    loose = [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(120)]
    links = list(zip(chain, chain[1:])) + star + loose + [(chain[3], chain[3]), (star[5][1], 2000)]
    want = components({i for pair in links for i in pair}, links)
    rows = spark.createDataFrame(links + [(None, 5), (4001, None)], "a long, b long")
    for most in (20, 1 << 18):
        got = {r["node"]: r["component"] for r in connected(rows.repartition(6), "test-links", most).collect()}
        assert got == {i: c for i, c in want.items() if i in got} and all(want[i] == i for i in want.keys() - got.keys())
