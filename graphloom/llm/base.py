"""Inputs and lineage cuts shared by the operators of this subpackage."""

from __future__ import annotations

import pickle
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, the cluster's setting, as it is.  Only a local session, as
    in tests on one machine, may go without: a folder is made for it."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the folder all executors share and goes on from there."""
    shared(df.sparkSession)
    return df.checkpoint()


class Sent:
    """An object that is sent to the executors once, by value with its class, so that they need no copy of this package.
    Each task makes it anew from the bytes; forget() gives its memory back."""

    def __init__(self, spark: SparkSession, value):
        self._sent, self._made = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return self._sent

    def __setstate__(self, sent):
        self._sent, self._made = sent, None

    @property
    def value(self):
        if self._made is None:
            self._made = pickle.loads(self._sent.value)
        return self._made

    def forget(self) -> None:
        self._made = None
        if hasattr(self._sent, "_value"):
            del self._sent._value

    def destroy(self) -> None:
        self._sent.destroy()


#: A sieve is so many buckets of 32 768 bits: 8 MB at most, whatever is put in it.
_BUCKETS = 2048


def sieve(keys: DataFrame, *columns: str) -> DataFrame:
    """A bit for each key (by its hash): what sifted() tells rows by that surely have none of the keys."""
    h = F.xxhash64(*columns)
    bit = F.pmod(F.shiftrightunsigned(h, 20), F.lit(32_768))
    return cut(keys.groupBy(F.pmod(h, F.lit(_BUCKETS)).cast("int").alias("__bucket")).agg(F.bitmap_construct_agg(bit).alias("__bits")))


def sifted(df: DataFrame, bits: DataFrame, *columns: str) -> DataFrame:
    """df with the boolean ``__maybe``: false only for rows whose columns are none of the sieve's keys.  With many keys
    more rows are true, all in the end; so a join by the keys follows, and only what it moves depends on this."""
    h = F.xxhash64(*columns)
    keyed = df.withColumns({"__bucket": F.pmod(h, F.lit(_BUCKETS)).cast("int"), "__bit": F.pmod(F.shiftrightunsigned(h, 20), F.lit(32_768)).cast("int")})
    hit = F.expr("coalesce(shiftright(cast(conv(hex(substring(__bits, __bit div 8 + 1, 1)), 16, 10) as int), __bit % 8) & 1 = 1, false)")
    return keyed.join(F.broadcast(bits), "__bucket", "left").withColumn("__maybe", hit).drop("__bucket", "__bit", "__bits")  # 8 MB at most


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and columns named) alone, so that no other column of the input can clash.

    Rows without a doc_id can't be named in a result and are left out; a missing text is empty."""
    columns = [F.col(f"`{c}`") for c in more]
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns
    )


def uniform(key: str, seed: str) -> str:
    """SQL (Spark's) for a number in [0, 1) that depends on the key and the seed alone."""
    return f"conv(substr(md5(concat('{seed}:', {key})), 1, 13), 16, 10) / 4503599627370496D"


def uniform_duckdb(key: str, seed: str) -> str:
    return f"(('0x' || substr(md5(concat('{seed}:', {key})), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"
