"""Registered corpus queries against their SQL, and the pipeline stage by stage against brute force."""

import base64
import hashlib
import sys

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from check_oracle import rows_of
from spruce.llm import queries
from test_text_ops import brute_components, brute_fingerprint
from test_whole_job import brute_long

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.Q[name](spark, SF)
    res = con.execute(queries.SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, res.fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "mixing", "encoding"]
    extra = spark.createDataFrame([(10 ** 6, None, None, "src0", None), (10 ** 6 + 1, "123", "en", "src0", 3)], docs.schema)
    rows = stages["language_id"](spark, docs.unionByName(extra), SF)
    assert rows.columns == docs.columns and rows.count() == docs.count()  # the two without a letter go

    before = sorted((r.doc_id, r.text) for r in rows.collect())
    rows = stages["line_dedup"](spark, rows, SF).cache()
    after = sorted((r.doc_id, r.text) for r in rows.collect())
    assert rows.columns == docs.columns and after == [(i, t) for (i, _), t in zip(before, brute_long(before, 3, 50))]
    assert all(r.n_chars == len(r.text) for r in rows.collect())

    kept = stages["near_dedup"](spark, rows, SF).cache()
    label = brute_components(sorted({brute_fingerprint(t) for _, t in after}), 3)
    first = {}
    for i, t in after:
        first.setdefault(label[brute_fingerprint(t)], i)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(first.values())

    mixed = stages["mixing"](spark, kept, SF).cache()
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} == {tuple(r) for r in kept.collect()}

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, len(ids := e.encode_ordinary(r.text)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())
    assert sorted(map(tuple, stages["encoding"](spark, mixed, SF).collect())) == want


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        docs.collect()


def test_run_equals_its_stages(spark):
    assert "spruce.llm" in sys.modules
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    rows = sorted(map(tuple, docs.collect()))
    assert rows and sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == rows
