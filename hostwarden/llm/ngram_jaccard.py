"""Exact n-gram Jaccard join, reported as classes, by prefix filters under several global token orders.

1. Texts with equal shingle sets are one node from the start, so copies cost one row each.
2. Order one puts rare shingles first, by counts over all texts in a table of fixed size. Two sets can only be
   similar enough if they share a shingle in their prefixes under this order, early enough in both.
3. Every shingle of a prefix proposes one pair per text: with the text that has it earliest. What these pairs link
   is merged; then each shingle proposes the remaining pairs between different classes. Pairs within a class cannot
   change a class, so a group of a million near copies never becomes a list of pairs, and no link is lost.
4. Under every further order (a mixed and a random one) a pair must share a prefix shingle too; pairs that fail any
   filter are dropped before verification.
5. The remaining pairs are verified on their whole sets, whose texts are found again with a bit table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostwarden.llm.support import bit_table, connected, maybe_in, packed_bits, prepare, summed_table, unpacked_bits
from hostwarden.llm.textbytes import lists, mix, salted, shingle_sets, text_slices
from hostwarden.session import release, stage

_BUCKETS = 1 << 20
#: Postings carry this part of a shingle's hash: another shingle with the same part costs a candidate, never a link.
_POSTING = np.uint64((1 << 48) - 1)


def _counts(docs: DataFrame, n: int) -> np.ndarray:
    def accumulate(batch: pa.RecordBatch, table: np.ndarray) -> None:
        for piece in text_slices(batch["text"]):
            _, tokens = shingle_sets(piece, n)
            table += np.bincount((tokens & np.uint64(_BUCKETS - 1)).astype(np.int64), minlength=_BUCKETS)

    return summed_table(docs.select("text"), accumulate, (_BUCKETS,))


def _prefixes(docs: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, percent: int, keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens of every set under the order of ``keys``: as many as a similar set cannot miss all of."""
    order = np.lexsort((tokens, *keys, docs))
    starts = np.cumsum(sizes) - sizes
    rank = np.arange(len(tokens)) - np.repeat(starts, sizes)
    length = np.where(sizes > 0, sizes - (percent * sizes + 99) // 100 + 1, 0)
    return tokens[order][rank < np.repeat(length, sizes)], length


def _orders(tokens: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    count = counts[(tokens & np.uint64(_BUCKETS - 1)).astype(np.int64)]
    level = np.log2(count + 1).astype(np.int64)
    return [(salted(tokens, 1), count), (salted(tokens, 2), level), (salted(tokens, 3),)]


_SETS = "doc_id long, n_shingles int, k1 long, k2 long, prefix array<long>"
_FACTS = "node long, tokens array<long>, second array<long>, third array<long>"


def _set_rows(counts, n: int, percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            for piece in text_slices(batch["text"]):
                docs, tokens = shingle_sets(piece, n)
                sizes = np.bincount(docs, minlength=piece.last - piece.first)
                ends = np.cumsum(sizes)
                sums = []
                for salt in (4, 5):
                    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted(tokens, salt), dtype=np.uint64)])
                    sums.append(mix(running[ends] - running[ends - sizes] + sizes.astype(np.uint64)).view(np.int64))
                # Below ten shingles only equal sets reach 90 percent; in general size / (size + 1) must reach the threshold.
                prefix, length = _prefixes(docs, tokens, sizes, percent, _orders(tokens, table)[0])
                alone = 100 * sizes < percent * (sizes + 1)
                prefix, length = prefix[~np.repeat(alone, length)], np.where(alone, 0, length)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"][piece.first : piece.last], pa.array(sizes.astype(np.int32)), pa.array(sums[0], mask=sizes == 0), pa.array(sums[1], mask=sizes == 0),
                    lists((prefix & _POSTING).view(np.int64), length, pa.int64()),
                ], ["doc_id", "n_shingles", "k1", "k2", "prefix"])

    return rows


def _fact_rows(counts, wanted: bytes, n: int, percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = unpacked_bits(wanted.value)
        for batch in batches:
            batch = batch.filter(pa.array(maybe_in(flags, batch["doc_id"].to_numpy(zero_copy_only=False))))
            for piece in text_slices(batch["text"]):
                docs, tokens = shingle_sets(piece, n)
                sizes = np.bincount(docs, minlength=piece.last - piece.first)
                _, second, third = _orders(tokens, counts.value)
                more = [_prefixes(docs, tokens, sizes, percent, keys) for keys in (second, third)]
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"][piece.first : piece.last], *(lists(v.view(np.int64), k, pa.int64()) for v, k in ((tokens, sizes), *more)),
                ], ["node", "tokens", "second", "third"])

    return rows


def _wanted_rows(wanted):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = unpacked_bits(wanted.value)
        for batch in batches:
            yield batch.filter(pa.array(maybe_in(flags, batch["node"].to_numpy(zero_copy_only=False))))

    return rows


def _possible(left: str, right: str, percent: int):
    """Whether two texts that share a token at these positions of their prefixes can still be similar enough."""
    n1, p1, n2, p2 = (F.col(f"{side}.{c}") for side in (left, right) for c in ("n", "pos"))
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) * (100 + percent) >= percent * (n1 + n2))


def similarity_classes(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id``.

    Words are runs of characters other than space and U+0009 to U+000D after lowering A-Z; a set holds the distinct
    ``n``-word shingles, or the whole sequence where there are fewer words. Two rows link when
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest id reachable. Shingles are compared by
    64-bit hashes. A null or empty text has size 0 and is its own component. A row without ``doc_id`` takes no part and
    has a null component. Rows that share an id are one document, so they link. Further columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = texts.where("doc_id IS NOT NULL")
    counts = spark.sparkContext.broadcast(_counts(known, n).astype(np.int64))
    rows = stage(texts.mapInArrow(_set_rows(counts, n, percent), _SETS), "jaccard-rows")
    nodes = stage(
        rows.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix")), "jaccard-nodes",
    )
    postings = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    repeated = postings.groupBy("token").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    shared = stage(postings.join(stage(repeated.select("token"), "jaccard-repeated"), "token"), "jaccard-shared")
    hubs = stage(shared.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("hub")), "jaccard-hubs")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stage(pairs.distinct(), "jaccard-pairs")
        if pairs.isEmpty():
            return pairs
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
        wanted = spark.sparkContext.broadcast(packed_bits(bit_table(ids, "id")))
        facts = stage(known.mapInArrow(_fact_rows(counts, wanted, n, percent), _FACTS), "jaccard-facts")
        narrow = [facts.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("second", "third"))) for s in "ab"]
        filtered = pairs.join(narrow[0], "a").join(narrow[1], "b").where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b"))
        kept = stage(filtered.select("a", "b").distinct(), "jaccard-filtered")
        left = spark.sparkContext.broadcast(packed_bits(bit_table(kept.select(F.explode(F.array("a", "b")).alias("id")), "id")))
        sets = facts.select("node", "tokens").mapInArrow(_wanted_rows(left), "node long, tokens array<long>")
        both = kept.join(sets.toDF("a", "tokens_a"), "a").join(sets.toDF("b", "tokens_b"), "b")
        common = F.size(F.array_intersect("tokens_a", "tokens_b"))
        union = F.size("tokens_a") + F.size("tokens_b")
        links = stage(both.where((100 + percent) * common >= percent * union).select("a", "b"), "jaccard-links")
        release(facts, pairs, kept)
        return links

    hub_pairs = shared.join(hubs, "token").alias("x").where((F.col("node") != F.col("hub.node")) & _possible("x", "hub", percent))
    links = verified(hub_pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")))

    classes = connected(links, "jaccard-hub")
    placed = stage(shared.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component"), "jaccard-placed")
    sizes = placed.groupBy("token", "class").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("token").agg(F.max(F.struct("k", "class")).alias("most"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    release(shared, hubs)
    open_rows = stage(placed.join(stage(mixed.select("token", F.col("most.class").alias("main")), "jaccard-mixed"), "token"), "jaccard-open")
    x, y = open_rows.where(F.col("class") != F.col("main")).alias("x"), open_rows.alias("y")
    apart = (F.col("x.class") != F.col("y.class")) & ((F.col("y.class") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & apart & _possible("x", "y", percent))
    more = verified(rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")))

    release(placed, open_rows)
    ids = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high")
    same = rows.join(ids, "doc_id").join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = classes.select(F.col("node").alias("a"), F.col("component").alias("b"))
    classes = connected(found.unionByName(more).unionByName(same), "jaccard-all")
    of_set = stage(nodes.join(classes, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component")), "jaccard-of-set")
    release(nodes)
    return rows.join(of_set, ["k1", "k2"], "left").select(
        "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
    ).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their class: the smallest id of each, every row without an id or words."""
    classes = similarity_classes(docs, n, percent)
    dropped = stage(classes.where("component_id <> doc_id").select("doc_id").distinct(), "jaccard-dropped")
    return docs.join(dropped, "doc_id", "left_anti")


SQL = r"""
WITH RECURSIVE low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM low),
sized AS (SELECT doc_id, s, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k FROM sets),
reps AS (SELECT k, any_value(s) AS s, any_value(n) AS n, min(doc_id) AS node FROM sized WHERE n > 0 GROUP BY k),
tok AS (SELECT node, n, unnest(s) AS t FROM reps),
links AS (
  SELECT a.node AS a, b.node AS b FROM tok a JOIN tok b ON a.t = b.t AND a.node < b.node AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS r FROM pairs UNION SELECT reach.node, pairs.b FROM reach JOIN pairs ON reach.r = pairs.a),
comp AS (SELECT node, min(r) AS c FROM reach GROUP BY node)
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_shingles, coalesce(comp.c, reps.node, z.doc_id) AS component_id
FROM sized z LEFT JOIN reps ON z.n > 0 AND reps.k = z.k LEFT JOIN comp ON comp.node = reps.node
"""
