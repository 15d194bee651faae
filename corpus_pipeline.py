"""A training corpus from the documents table: rank quality, drop near copies, drop benchmark leaks, mix
sources and place the rows in shards.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and keeps the columns
of docs; the last one adds ``shard``.  Extra columns are kept whatever their names; an empty table gives an empty one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, mixing, neardup, quality, shards
from graphloom.llm.base import read, shared


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects.  Null and empty texts are scored as texts of no words, rows without a
    doc_id by their text; repeated rows and ties with the threshold are judged alike; without labels of both kinds all stay."""
    return quality.keep(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id.  Rows without a doc_id or without words all stay; of
    repeated rows one stays; texts that share a doc_id are told apart."""
    return neardup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose text holds a benchmark passage, whatever their doc_id; null and empty texts stay."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its source's epochs and the seeded draw by doc_id ask for.  A null source or doc_id counts as an
    empty name; rows of a source without characters are kept once; texts don't matter."""
    return mixing.mix(docs).select(*[f"`{c}`" for c in docs.columns])


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the column ``shard`` (one of docs that has this name becomes ``shard_in``); a null doc_id is placed like an empty key."""
    return shards.assign(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing to target weights", mix_sources),
    ("sharding", place_in_shards),
]

#: Ranking by a trained classifier and connected components can't be told in SQL; the tests hold the
#: stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir.  What a stage returns is written in the folder that all
    executors share and read again for the next one, and its input is deleted then."""
    context = spark.sparkContext
    base = f"{shared(spark)}/corpus-{uuid.uuid4().hex}"
    hadoop = context._jvm.org.apache.hadoop.fs.Path
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            old = hadoop(f"{base}/{k - 1}")
            old.getFileSystem(context._jsc.hadoopConfiguration()).delete(old, True)
    return docs
