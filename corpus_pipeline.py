"""Cleaning, deduplicating, mixing and sharding a corpus: the stages, and the run over ``documents``.

Every stage takes whatever the one before it kept, null and empty texts, repeated rows,
empty tables and additional columns included, and all but the last return the columns
of ``documents``:

* language: documents whose language cannot be told go; a null text has none.
* near_duplicates: of each group of documents linked by shared word 5-grams the one with
  the smallest id stays, of repeated rows one. Rows without an id stay.
* decontamination: documents that hold a benchmark item go.
* mixing: documents of each source as often as the target weights ask for, also not at all.
* sharding: id, size, checksum, shard and slot of every row of the mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikisift.llm import decontamination, language, mixing, ngram_join, sharding
from wikisift.sources.tables import scratch_dir

SHARDS = 24


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs.where(language.fold() != 0))
    return language.keep_identified(docs, model, min_score=0.2)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join.near_duplicates(docs)
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    same, row = "_same_text", "_own_row"
    kept = kept.withColumns({same: F.xxhash64("text"), row: F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())})
    return kept.dropDuplicates(["doc_id", same, row]).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs, shards=SHARDS).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(docs, SHARDS)


STAGES = [
    ("language", identified), ("near_duplicates", one_of_each_group), ("decontamination", without_benchmark),
    ("mixing", mixed), ("sharding", sharded),
]

# Models, similarity joins and alignments have no SQL form; the tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = f"{scratch_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{work}/{name}")
        docs = spark.read.parquet(f"{work}/{name}")
    return docs
