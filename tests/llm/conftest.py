import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def shingles(text, n):
    w = plain_words(text)
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def components(ids, links):
    """Smallest id reachable, by plain union-find."""
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    """Documents with nulls, empty and long texts, copies, repeated rows and columns with clashing names."""

    def build(rows, more=True):
        ddl = "doc_id long, text string, lang string, source string, n_chars long" + (", token string, seed long, node long, words int" if more else "")
        data = [(i, t, "en", "s", len(t or "")) + (("x", 1, 2, 3) if more else ()) for i, t in rows]
        return spark.createDataFrame(data, ddl)

    return build
