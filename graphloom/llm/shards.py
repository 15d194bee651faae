"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 1024


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every 64-bit key: Lamping and Veach's jump hash, all keys at once."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            shard[live] = ahead[live]
            k = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            key[live] = k
            # integers throughout: floor((b + 1) * 2**31 / ((k >> 33) + 1)), exact and the same everywhere
            ahead[live] = ((shard[live] + 1) << 31) // ((k >> np.uint64(33)).astype(np.int64) + 1)
            live = live[ahead[live] < shards]
    return shard


def shard_column(key: Column, shards: int = SHARDS) -> Column:
    """The shard (int) of a key of any type, by the first 64 bits of the md5 of its text."""

    @F.arrow_udf("int")
    def place(digests: pa.Array) -> pa.Array:
        at = np.frombuffer(digests.buffers()[1], np.int32, len(digests) + 1, digests.offset * 4)
        keys = np.frombuffer(digests.buffers()[2], ">u8", len(digests), at[0]) if len(digests) else np.zeros(0)
        return pa.array(jump(keys.astype(np.uint64), shards), pa.int32())

    return place(F.unhex(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 16)))


def assign(docs: DataFrame, shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """docs with the column ``name``.

    A column of docs that has this name already is kept as ``<name>_in`` (once more ``_in`` while that is taken).  A null doc_id is placed like an empty key.  Repeated rows get the same shard; texts don't matter;
    an empty table stays empty.  No row is moved: a writer may repartition by the column."""
    taken = {c.lower() for c in docs.columns}
    if name.lower() in taken:
        other = f"{name}_in"
        while other.lower() in taken:
            other += "_in"
        docs = docs.withColumnRenamed(name, other)
    return docs.withColumn(name, shard_column(F.col("doc_id"), shards))


def query(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, shard, shard_after): the second with one more shard appended."""
    return docs.select("doc_id", shard_column(F.col("doc_id"), shards).alias("shard"), shard_column(F.col("doc_id"), shards + 1).alias("shard_after"))


def sql(shards: int = SHARDS) -> str:
    """The same in DuckDB: a key's candidates rise, and its shard is the last one below the number."""
    return f"""with recursive keys as (
  select row_number() over () as id, doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT::HUGEINT as k from documents
), steps as (
  select id, k, 0::HUGEINT as j from keys
  union all
  select id, k2, ((j + 1) * 2147483648::HUGEINT) // (k2 // 8589934592::HUGEINT + 1)
  from (select id, j, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT as k2 from steps where j <= {shards})
)
select any_value(doc_id) as doc_id, (max(j) filter (where j < {shards}))::INT as shard, (max(j) filter (where j <= {shards}))::INT as shard_after
from keys join steps using (id) group by id"""
