"""The corpus pipeline: language ID, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and all but the last return the columns of
``documents``. Stages see all rows that the one before kept:

* language_id drops texts that no language can be told of (null, or no letters);
* ngram_join keeps the document of the smallest doc_id of each near-duplicate class;
* suffix_dedup cuts bytes that a document of a smaller doc_id holds within a
  50-byte string, and keeps the rows;
* secret_scan masks secrets;
* packing gives the pieces of sequences.

Null texts go with the first stage, as no language can be told of them; a stage by
itself keeps them. Rows with a null or repeated id count by their text (see
``ngram_join.keep_one_of_each``). Ties go to the smaller id, repeated rows are near
duplicates of each other, long texts are worked on whole, other columns pass
unchanged whatever their names, and an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import language_id, ngram_join, packing, secret_scan, suffix_dedup
from helixframe.llm.common import discard, release_heaps, shared_path, smaller_batches


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_small_batches(stage: Stage) -> Stage:
    """The stage; what it runs before it returns its plan runs with small Arrow batches."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with smaller_batches(spark):
            return stage(spark, docs, sf_dir)

    return run_stage


def from_small_heaps(stage: Stage) -> Stage:
    """The stage; executors first give back the heap that what ran before has grown and left."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", from_small_heaps(identify_languages)),
    ("ngram_join", from_small_heaps(with_small_batches(drop_near_duplicates))),
    ("suffix_dedup", from_small_heaps(cut_repeats)),
    ("secret_scan", from_small_heaps(mask_secrets)),
    ("packing", from_small_heaps(with_small_batches(pack_sequences))),
]

#: SQL can't express the models and ranks; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, which cuts lineage.

    What a stage was made from is deleted once its own result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    with smaller_batches(spark):
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path := shared_path(spark, name))
            docs = spark.read.parquet(path)
            discard(spark, *before)
            before = [path]
        return STAGES[-1][1](spark, docs, sf_dir)
