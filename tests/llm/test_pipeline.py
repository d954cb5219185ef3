import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.conftest import components, plain_words, shingles
from tests.oracle_compare import compare, connect


@pytest.mark.parametrize("name", ["op4_ngram_jaccard", "op7_embedding_dedup"])
def test_query_matches_sql(spark, small, name):
    ok, note = compare(spark, connect(small), name, entry.queries()[name], entry.oracle_sql()[name], small)
    assert ok, note


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_stages(spark, small):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [plain_words(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, small)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(now) <= set(kept) and len(now) == docs.count()
        if name == "language_id":
            assert now == kept
        if name == "ngram_jaccard_join":
            sets = {i: shingles(t, 5) for i, t in kept.items()}
            ids = sorted(sets)
            links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert set(now) == set(components(ids, links).values())
        if name == "substring_dedup":
            windows = {}
            for i in sorted(now):
                w = plain_words(now[i])
                for k in range(len(w) - 50):
                    assert windows.setdefault(tuple(w[k : k + 51]), i) == i
            changed = [i for i in kept if now.get(i) != kept[i]]
            before = [tuple(plain_words(t)[k : k + 20]) for i, t in kept.items() if i not in changed for k in range(len(plain_words(t)) - 19)]
            for i in changed:  # what was cut has a counterpart elsewhere
                w = plain_words(kept[i])
                assert any(tuple(w[k : k + 20]) in set(before) for k in range(len(w) - 19)) or len(changed) > 1
        if name == "benchmark_decontamination":
            held = {i for i, t in kept.items() if any(" ".join(x) in " ".join(plain_words(t)) for x in items if len(x) >= 13)}
            assert not held & set(now)
            grams = {tuple(x[k : k + 8]) for x in items for k in range(len(x) - 7)}
            clean = {i for i, t in kept.items() if not grams & {tuple(plain_words(t)[k : k + 8]) for k in range(len(plain_words(t)) - 7)}}
            assert clean <= set(now)
        kept = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    words = {}
    for r in packed:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
    assert words == {i: len(plain_words(t)) for i, t in kept.items() if plain_words(t)}


def test_empty_corpus(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, small).count() == 0
