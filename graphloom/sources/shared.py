"""Where intermediate tables go, so that any executor may be lost."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.  Only a local session, as in tests on
    one machine, may go without: a folder is made for it.  On a cluster the setting is needed."""
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
    """The rows, written to the folder that all executors share; their history ends there."""
    folder(df.sparkSession)
    # what a checkpoint's rows obey is carried on by the optimiser; large expressions would multiply over the rounds of a loop
    conf, name = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(name, "true")
    conf.set(name, "false")
    try:
        return df.checkpoint()
    finally:
        conf.set(name, before)
