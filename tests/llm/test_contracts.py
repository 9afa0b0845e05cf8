"""Registered queries against a second computation at sf0.001, and what their operators promise at other sizes."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spruce.llm import ann, orcstore, quality, queries, sharding, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op9_whole_contract(spark, docs):
    rows = queries.Q["op9_histogram_shards"](spark, SF).collect()
    assert [f.simpleString() for f in queries.Q["op9_histogram_shards"](spark, SF).schema.fields] == [
        "doc_id:bigint", "size:bigint", "text_crc32:bigint", "law:string", "shard:int", "slot:bigint", "grown_shard:int"]
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots, sizes, of_text = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        data = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None) and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        of_text[data].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, most = sum(sizes.values()) / 8, max(r.size for r in rows)
    assert len(sizes) == 8 and all(abs(s - mean) <= 0.02 * mean + most for s in sizes.values())
    assert all(len(s) <= 2 for s in of_text.values()) and sum(len(s) > 1 for s in of_text.values()) <= 7  # a group meets a splitter at most


def test_splitters_for_many_parts(spark):
    rows = spark.range(40_000).select(F.col("id").alias("k1"), F.xxhash64("id").alias("k2"), (F.col("id") % 7 + 1).alias("size"))
    bounds = sharding.splitters(rows, 5_000, 0.5)
    assert len(bounds) == 4_999 and bounds == sorted(bounds)
    parts = rows.withColumn("part", sharding.part_of(F.col("k1"), F.col("k2"), bounds))
    assert parts._jdf.queryExecution().analyzed().toString().count("CASE WHEN") == 1  # whatever the number of bounds
    sizes = {r.part: r.s for r in parts.groupBy("part").agg(F.sum("size").alias("s")).collect()}
    assert set(sizes) == set(range(5_000)) and max(sizes.values()) <= 3 * 160_000 / 5_000
    for r in parts.where("k1 % 997 = 0").collect():
        assert r.part == sum(x <= (r.k1, r.k2) for x in bounds)


def test_splitters_through_a_hot_key(spark):
    rows = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, F.lit(5).cast("long")).otherwise(F.xxhash64("id")).alias("k1"),
                                     F.col("id").alias("k2"), F.lit(1).cast("long").alias("size"))
    bounds = sharding.splitters(rows, 12, 0.01)
    parts = rows.groupBy(sharding.part_of(F.col("k1"), F.col("k2"), bounds).alias("p")).count().collect()
    assert len(parts) == 12 and max(r["count"] for r in parts) <= 1.05 * 750


def test_op2_and_op8_and_op10_columns(spark, docs):
    """Names and casts of the thin queries; their operators are compared with brute force elsewhere."""
    two = {r.doc_id: r for r in queries.Q["op2_simhash_near_dedup"](spark, SF).collect()}
    same = defaultdict(set)
    for i, r in two.items():
        assert len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() and r.component_id <= i
        same[docs[i].text].add((r.fingerprint, r.component_id))
    assert set(two) == set(docs) and all(len(x) == 1 for x in same.values())
    for r in queries.Q["op8_byte_bpe"](spark, SF).collect():
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id].text or "").encode()).hexdigest()
    at = 0
    for r in sorted(queries.Q["op10_orc_token_ids"](spark, SF).collect(), key=lambda r: r.doc_id):
        assert r.start == at and r.n_tokens >= 1
        at += r.n_tokens


def test_op5_columns(spark, docs):
    order = sorted(docs)
    rows = {r.doc_id: r for r in queries.Q["op5_edit_fingerprints"](spark, SF).collect()}
    prints = {i: rows[i].fingerprint for i in order}
    for i, nxt in zip(order, order[1:] + order[:1]):
        own, follow = docs[i].text or "", docs[nxt].text or ""
        half = len(own) // 2
        edited = own[:len(own) - half] + follow[:half]
        r = rows[i]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (edited != own or r.near_edited == 1)
    same = defaultdict(set)
    for i in order:
        same[docs[i].text].add(prints[i])
    assert all(len(x) == 1 for x in same.values())


@pytest.mark.parametrize("n", [400, 4000])
def test_nearest_through_hashing(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(df, F.col("id") % 20 == 0, k=20, whole=0).collect():
        got[r.query_id].add(r.vec_id)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    recall = np.mean([len(got[i] & set(np.argsort(-s[i])[:20])) / 20 for i in range(0, n, 20)])
    assert recall >= 0.9


def test_fewer_axes_for_larger_tables():
    probes = [ann.probes_for(n) for n in (1, 500, 5_000, 50_000, 5 * 10 ** 6, 10 ** 12)]
    assert probes == sorted(probes, reverse=True) and probes[0] == 40 and probes[3] < 20 and probes[-1] >= 2


def test_labels_that_are_no_labels_are_none(spark):
    texts = ["Good words in a sound order, with an end.", "bad bad bad bad", "x1 x2 !!!!"]
    docs = spark.createDataFrame([(i, texts[i % 3] + f" {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "1" if i % 3 == 0 else "0" if i % 3 == 1 else ["0.5", "0.9", "yes", None][i % 4]) for i in range(60)],
                                   "doc_id long, quality string")
    clean = labels.where("quality IN ('0', '1')").select("doc_id", F.col("quality").cast("int").alias("quality"))
    one = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    assert one == {r.doc_id: r.score for r in quality.quality(docs, clean).collect()} and len(set(one.values())) > 1


def test_one_of_rows_equal_in_id_and_text(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "x"), (2, "a b c d", "z"), (3, "q r s t u v", "w"), (None, "q r s t u v", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [sorted(map(tuple, simhash.keep_one(df.repartition(n), shingle=3, max_bits=3).collect()), key=str) for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2] and [r[0] for r in kept[0]] == [1, 3] and df.columns == ["doc_id", "text", "source"]


def test_vocabulary_that_keeps_blanks_gets_whole_texts():
    from public_tokenizers import path
    assert orcstore.WordEncoder(path("word_bpe_49k.json")).splits
    other = orcstore.WordEncoder(path("byte_bpe_50k.json"))
    assert not other.splits and other.encode([b"ab cd, ef"]) == [other.whole(b"ab cd, ef")]
