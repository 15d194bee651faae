"""Triple stores: where statements are kept and how they are laid out."""

from __future__ import annotations

import importlib
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as t
from ..operators import rdfs


class ParquetStore:
    """Statements as Parquet, a folder for each predicate, sorted inside by an index order such as ``psoc``.

    Readers with a constant predicate touch its folder alone."""

    def __init__(self, spark: SparkSession, path: str, indexes: str = "psoc"):
        self.spark, self.path, self.indexes = spark, path, indexes

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(t.SCHEMA).parquet(self.path)
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            return self.spark.createDataFrame([], t.SCHEMA)

    def _sorted(self, statements: DataFrame) -> DataFrame:
        order = [c for c in self.indexes.lower() if c in "spo"]
        # a predicate's rows may be most of the store: the rows are brought together by it in tasks of about one size
        return statements.select(t.SCHEMA.names).hint("rebalance", "p").sortWithinPartitions("p", *[c for c in order if c != "p"])

    def replace(self, statements: DataFrame) -> None:
        """Keeps these statements only.  They may come from the store itself: the new table is complete
        before the old one goes."""
        fresh = self.path.rstrip("/") + "__new"
        self._sorted(t.distinct(statements)).write.mode("overwrite").partitionBy("p").parquet(fresh)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        old, new = path(self.path), path(fresh)
        files = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(old, True)
        files.rename(new, old)

    def add(self, statements: DataFrame) -> None:
        """Appends statements that the store doesn't hold yet; an explicit one replaces its inferred twin at
        the next replace()."""
        held = self.read()
        fresh = t.distinct(statements).alias("n")
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}")) for c in t.KEY] + [F.col("n.inferred") == F.col("h.inferred")]
        on = same[0]
        for c in same[1:]:
            on &= c
        self._sorted(fresh.join(held.alias("h"), on, "left_anti")).write.mode("append").partitionBy("p").parquet(self.path)


class TableStore(ParquetStore):
    """The same in a catalogue table."""

    def read(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.path):
            return self.spark.createDataFrame([], t.SCHEMA)
        return self.spark.table(self.path).select(t.SCHEMA.names)

    def replace(self, statements: DataFrame) -> None:
        fresh = self.path + "__new"
        self._sorted(t.distinct(statements)).write.mode("overwrite").partitionBy("p").saveAsTable(fresh)
        # the new rows are complete in a table of their own before the old ones go
        self.spark.table(fresh).write.mode("overwrite").partitionBy("p").saveAsTable(self.path)
        self.spark.sql(f"DROP TABLE {fresh}")

    def add(self, statements: DataFrame) -> None:
        self.replace(self.read().unionByName(statements))


class JdbcStore:
    """The same in a table of a database, by Spark's JDBC source; reads are divided by ``partitionColumn`` options."""

    def __init__(self, spark: SparkSession, options: dict[str, str]):
        self.spark, self.options = spark, options

    def read(self) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options).load().select(t.SCHEMA.names)

    def add(self, statements: DataFrame) -> None:
        t.distinct(statements).join(self.read().select(t.KEY), t.KEY, "left_anti").write.format("jdbc").options(**self.options).mode("append").save()

    def replace(self, statements: DataFrame) -> None:
        # rows read from the table itself would be gone before they are written
        raise NotImplementedError("a database table is appended to; delete there")


BACKENDS = {
    "parquet": lambda spark, p: ParquetStore(spark, p["dataDir"], p.get("indexes", "psoc")),
    "table": lambda spark, p: TableStore(spark, p["table"], p.get("indexes", "psoc")),
    "jdbc": lambda spark, p: JdbcStore(spark, {k[5:]: v for k, v in p.items() if k.startswith("jdbc.")}),
}


def open_store(spark: SparkSession, properties: dict[str, str], working_dir: str = "."):
    """(store, infer) of properties: ``connFactory`` names a backend or a ``module:callable``; ``dataDir`` is
    relative to the working folder; ``inferencer`` is ``rdfs``, a ``module:callable``, or missing.

    An inferencer that can't be found is left out, with a warning as the third value."""
    p = dict(properties)
    if "dataDir" in p and not re.match(r"[A-Za-z][\w+.\-]+:", p["dataDir"]):
        p["dataDir"] = os.path.join(working_dir, p["dataDir"].replace("\\", "/"))
    name = p.get("connFactory", "parquet")
    made = BACKENDS[name](spark, p) if name in BACKENDS else _load(name)(spark, p)
    infer, warning = None, None
    if p.get("inferencer"):
        try:
            infer = rdfs.infer if p["inferencer"].lower() == "rdfs" else _load(p["inferencer"])
        except (ImportError, AttributeError, ValueError) as problem:
            warning = f"no inference: {problem}"
    return made, infer, warning


def _load(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def properties(path: str) -> dict[str, str]:
    """A Java properties file: ``key=value`` or ``key: value`` lines, ``#`` and ``!`` comments, ``\\\\`` for a backslash."""
    out = {}
    with open(path, encoding="utf-8") as lines:
        for line in map(str.strip, lines):
            if line and line[0] not in "#!":
                at = min((line.find(c) for c in "=:" if c in line), default=len(line))
                out[line[:at].strip()] = line[at + 1 :].strip().replace("\\\\", "\\")
    return out
