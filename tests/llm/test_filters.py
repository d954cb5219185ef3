import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostwarden.llm import importance, language_id, licenses, packing, queries, toxicity, warc

SF = "/root/testdata/sf0.01"


def test_fold_undoes_disguises():
    assert toxicity.fold("Ｉd1оt, cl0wn!") == toxicity.fold("idiot clown")
    assert toxicity.fold("Cl@$sy") == toxicity.fold("classy") and toxicity.fold("") == "  "


def test_exceptions_and_boundaries():
    model = toxicity.Model(((toxicity.fold("trash"), 2.0), (" moro", 1.0)), ("trash can",), (0.0, 1.0, 1.0, 1.0))
    machine = toxicity.automaton(model)
    assert toxicity.hits(machine, toxicity.fold("such trash, m0rons")) == (3.0, 2)
    assert toxicity.hits(machine, toxicity.fold("a trash can")) == (0, 0)
    assert toxicity.hits(machine, toxicity.fold("retrash trashy")) == (0, 0)


def test_toxicity_learns(spark, texts):
    rng = random.Random(1)
    word = lambda: f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('mnprt')}{rng.randrange(60)}x"
    rows = [(k, " ".join([word() for _ in range(50)] + (["vilefoo" + rng.choice(["", "ish", "ly"])] if k % 4 == 0 else []))) for k in range(400)]
    docs = texts(rows)
    labelled = docs.where("doc_id < 300").withColumn("toxic", (F.col("doc_id") % 4 == 0).cast("int"))
    model = toxicity.train(labelled)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert all(got[k] == int(k % 4 == 0) for k in range(300, 400))
    odd = toxicity.score(texts([(1, None), (2, ""), (None, "vilefoo"), (3, "v1lefoo " * 5000), (3, "v1lefoo " * 5000)]), model).orderBy("doc_id").collect()
    assert [r["predicted"] for r in odd] == [1, 0, 0, 1, 1] and all(0 <= r["score"] <= 1 for r in odd)


def test_toxicity_without_labels(spark, texts):
    none = texts([]).withColumn("toxic", F.lit(0))
    assert toxicity.score(texts([(1, "some text")]), toxicity.train(none)).collect()[0]["predicted"] == 0


def test_toxicity_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = queries.QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id")
    hit = got.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("double")).alias("a"), F.sum(F.expr("toxic * predicted")).alias("tp"), F.sum("toxic").alias("p"), F.sum("predicted").alias("pp")).first()
    assert hit["a"] > 0.97 and hit["tp"] / hit["p"] > 0.85 and hit["tp"] / hit["pp"] > 0.9


def test_language_of_documents_and_pages(spark):
    got = queries.QUERIES["op6_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    assert got.join(docs, "doc_id").where("lang <> truth OR NOT accepted").count() == 0
    assert got.where("page_id IS NOT NULL AND lang <> declared").count() == 0 and got.count() == docs.count() + spark.read.parquet(f"{SF}/pages.parquet").count()


def test_language_evidence_and_odd_rows(spark):
    train = spark.createDataFrame([("the cat sat on the mat " * 4000, "en"), ("die katze sass auf der matte " * 4000, "de-DE"), (None, "fr"), ("x", None), ("zz", "not a code")], "text string, lang string")
    model = language_id.train(train)
    assert model.languages == ("de", "en")
    rows = [(k, "the cat sat", None, "org", "a.org") for k in range(30)] + [(100, "", "en", "org", "a.org"), (101, None, None, None, None), (102, "123 !!", None, None, None), (103, "привет как дела это текст", None, None, None), (104, "Die Katze sass", "klingon", None, None), (104, "Die Katze sass", "klingon", None, None)]
    got = {}
    for r in language_id.identify(spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string"), model, ["id"]).collect():
        got.setdefault(r["id"], []).append((r["lang"], r["accepted"]))
    assert got[0] == [("en", True)] and got[104] == [("de", True)] * 2
    assert all(got[k] == [(None, False)] for k in (100, 101, 102, 103))
    empty = language_id.train(train.limit(0))
    assert language_id.identify(spark.createDataFrame(rows[:2], "id long, text string, declared string, suffix string, host string"), empty, ["id"]).where("accepted").count() == 0


def test_priors_decide_what_text_leaves_open(spark):
    """Without letters that tell, the declaration and the host's other pages do."""
    train = spark.createDataFrame([("aaa bbb ccc " * 30 + "xxx", "en"), ("aaa bbb ccc " * 30 + "yyy", "de")], "text string, lang string")
    model = language_id.train(train)
    rows = [(k, "xxx xxx xxx xxx", "en", "uk", "h") for k in range(60)] + [(k, "yyy yyy yyy yyy", "de", "de", "g") for k in range(60, 120)] + [(200, "aaa", None, "uk", "h"), (201, "aaa", None, "de", "g"), (202, "aaa", "de", None, None), (203, "aaa", "en", None, None)]
    got = {r["id"]: r["lang"] for r in language_id.identify(spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string"), model, ["id"]).collect()}
    assert [got[k] for k in (200, 201, 202, 203)] == ["en", "de", "de", "en"]


def test_importance_model_and_top_k(spark, texts):
    docs = texts([(k, ("good words here and more " if k % 2 else "junk $$$ ### @@@ ") * 20) for k in range(100)] + [(200, None), (201, ""), (300, "good words"), (300, "good words")])
    model = importance.train(docs, docs.where("doc_id % 2 = 1 AND doc_id < 60"))
    got = importance.resample(docs, model, 0.5).collect()
    keys = sorted((round(r["key"] * 1e6) for r in got), reverse=True)
    last = keys[-(-len(keys) // 2) - 1]
    assert all(r["selected"] == (round(r["key"] * 1e6) >= last) for r in got) and len(got) == 104
    assert sum(r["selected"] for r in got if r["doc_id"] is not None and r["doc_id"] < 100 and r["doc_id"] % 2) > 45
    assert all(r["log_weight"] == 0 for r in got if r["doc_id"] in (200, 201))
    assert importance.resample(texts([]), model).count() == 0


def test_kth_largest(spark):
    values = [int(x) for x in np.random.default_rng(2).integers(-(10**15), 10**15, 300)] + [0, 0, -5, 7]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 150, len(values)):
        assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_gumbel_top_k_follows_weights(spark):
    """Inclusion frequencies of a sample of one out of three items of weight 1, 2 and 3."""
    df = spark.range(6000).withColumn("k", F.col("id") % 3)
    uniform = (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    won = df.withColumn("key", F.log(F.col("k") + 1) - F.log(-F.log(uniform))).groupBy(F.expr("id div 3")).agg(F.max_by("k", "key").alias("k")).groupBy("k").count().collect()
    assert {r["k"]: round(r["count"] / 2000, 1) for r in won} == {0: 0.2, 1: 0.3, 2: 0.5}


@pytest.fixture(scope="module")
def license_model(spark):
    return licenses.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_licenses(spark, texts, license_model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    wording = {"GPL-3.0": "GNU General Public License, version 3", "MIT": "Released under the MIT License", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0", "Apache-2.0": "Apache License, Version 2.0"}
    truth = {(r["doc_id"], f) for f, phrase in wording.items() for r in docs.where(F.col("text").contains(phrase)).select("doc_id").collect()}
    assert {(r["doc_id"], r["family"]) for r in licenses.scan(docs, license_model).where("confirmed").collect()} == truth
    odd = texts([(1, None), (2, ""), (3, "filler words " * 200 + "Licensed under the Apache License, Version 2.0." + " more of it" * 100), (None, "Released under the MIT License."), (4, "License of a driver, version of a story")])
    got = {(r["doc_id"], r["family"]) for r in licenses.scan(odd, license_model).where("confirmed").collect()}
    assert got == {(3, "Apache-2.0"), (None, "MIT")}
    assert licenses.scan(texts([]), license_model).count() == 0


def test_paragraphs_against_loop():
    import pyarrow as pa

    from hostwarden.llm.textbytes import text_slices, words

    texts = ["a b\nc\n\n" + " ".join(map(str, range(200))), "", "x " * 65, "one"]
    (piece,) = text_slices(pa.array(texts))
    w = words(piece)
    p = licenses.paragraphs(piece, w)
    want, at = [], 0
    for d, t in enumerate(texts):
        for line in t.split("\n"):
            n = len(line.split())
            want += [(d, at + s, min(at + s + 64, at + n)) for s in range(0, max(1, n - 32), 32) if n]
            at += n
    assert list(zip(p.doc.tolist(), p.start.tolist(), p.end.tolist())) == want


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x?é", '<html><head><title>T &amp; U</title><script>no()</script></head><body><p>One</p><p>Two&nbsp;é<br>3 < 4</p><a href="/l">L</a></body>', 0), (2, None, None, 1), (3, "http://b.org", "", 2), (3, "http://b.org", "", 2)], "page_id long, url string, html string, content int")
    responses = warc.responses(pages)
    source = {r["record_id"]: r for r in responses.collect()}
    records = warc.derivatives(responses)
    rows = {r["record_id"]: r for r in records.collect()}
    assert records.count() == 8 and len(rows) == 6
    import gzip

    parsed = warc.parse(gzip.decompress(b"".join(r["member"] for r in warc.members(records).collect())))
    assert len(parsed) == 8
    for head, block in parsed:
        row, of = rows[head["WARC-Record-ID"]], source[head["WARC-Refers-To"]]
        assert warc.digest(block) == head["WARC-Block-Digest"] == row["block_digest"] and len(block) == row["content_length"]
        assert head["WARC-Source-Payload-Digest"] == warc.digest(bytes(of["payload"])) and head.get("WARC-Target-URI") == of["target_uri"]
        assert rows[head["WARC-Concurrent-To"]]["refers_to"] == row["refers_to"] and rows[head["WARC-Concurrent-To"]]["record_type"] != row["record_type"]
    one = {r["record_type"]: r["content"] for r in rows.values() if r["page_id"] == 1}
    meta = json.loads(one["metadata"])
    assert one["conversion"] == "T & U\nOne\nTwo é\n3 < 4\nL" and meta["title"] == "T & U" and meta["links"] == ["/l"] and meta["headers"]["Content-Type"].startswith("text/html")
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_best_fit_against_bounds():
    rng = random.Random(2)
    lengths = [rng.randrange(1, 2000) for _ in range(600)] + [8192, 8192, 1]
    bins, kept = packing.best_fit(lengths)
    used = [0] * len(kept)
    for p, b in enumerate(bins):
        used[b] += lengths[p]
    assert all(u <= c and c in packing.CAPACITIES for u, c in zip(used, kept))
    assert all(c == min(x for x in packing.CAPACITIES if x >= u) for u, c in zip(used, kept))
    assert sum(kept) <= 1.02 * sum(lengths) + 256
    assert packing.best_fit([]) == ([], [])


def test_pack_loses_nothing(spark, texts):
    rows = [(k, "w " * (k * 37 % 900)) for k in range(200)] + [(500, "w " * 20000), (501, None), (502, ""), (None, "a b"), (503, "c d"), (503, "c d")]
    got = packing.pack(texts(rows)).collect()
    words = {}
    for r in got:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
    assert words == {**{k: k * 37 % 900 for k in range(200) if k * 37 % 900}, 500: 20000, None: 2, 503: 4}
    for b in {r["bin_id"] for r in got}:
        own = sorted((r["bin_start"], r["n_words"]) for r in got if r["bin_id"] == b)
        assert [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        (capacity,) = {r["capacity"] for r in got if r["bin_id"] == b}
        assert sum(n for _, n in own) <= capacity
    assert packing.pack(texts([])).count() == 0
