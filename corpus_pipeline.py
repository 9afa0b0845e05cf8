"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame.  All stages but the last return the columns of
``documents`` as they came, further columns included:

* language_id drops the documents without a language (null text, or no letter);
* line_dedup deletes later repeated runs of lines from the texts (n_chars follows);
* near_dedup keeps one document of each group of near-equal SimHash fingerprints;
* mixing repeats the rows of small sources up to the target weights, and drops none;
* encoding returns doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row.

Defined results, by stage: a null text goes in language_id (if one comes later: line_dedup leaves it null, near_dedup and encoding
take it as empty, mixing as one token); an empty text is kept from line_dedup on; null ids come after all others and are kept; repeated rows
are one document in line_dedup, one of them stays in near_dedup; a null source is a source of its own in mixing; columns of any
names go through all stages but the last; an empty table is an empty table in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spruce.llm import bpe, langid, linededup, mixing, simhash
from spruce.llm.common import column, held_out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs, where=~held_out(F.col("doc_id")))
    whole = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("row"), "text")
    return langid.identify(whole, model).where("lang_pred <> 'und'").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(docs)  # runs of three lines, and shorter ones of over 50 words
    return found.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("row"), "doc_id", "source", "text")
    return mixing.mix(whole, target_entropy=0.9, max_repeats=4.0).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("mixing", mixed_sources), ("encoding", encoding)]

#: SQL cannot express the stages; tests/llm/test_pipeline.py runs them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
