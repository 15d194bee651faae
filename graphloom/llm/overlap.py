"""Pairs of sketches that share many values, by inverted lists with an exact prefix filter.

If two sketches share at least ``c`` of their values, then, with the values in any one order, they
share a value among the first ``len - c + 1`` of each.  In the order *rarest first* the long lists
(a passage that thousands of documents have) drop out of that prefix, so the lists that are
compared stay short without a cap, and no pair is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_lists(sketches: DataFrame, share: float) -> DataFrame:
    """(value, id) that may prove a pair sharing ``share`` of the larger sketch's values.

    ``sketches``: (id bigint, values array<bigint> without repeats).  How many sketches have a value is summed before
    anything moves and joined back, so a value that all have is no single task's matter."""
    posting = sketches.select("id", F.size("values").alias("size"), F.explode("values").alias("value"))
    frequent = posting.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    counted = posting.join(frequent, "value")
    of_id = Window.partitionBy("id")  # as many rows as a sketch has values
    # values that no other sketch has are the rarest: they come first and need not be kept
    placed = counted.withColumn("alone", F.col("size") - F.count(F.lit(1)).over(of_id)).withColumn(
        "place", F.row_number().over(of_id.orderBy("df", "value")) + F.col("alone")
    )
    return placed.where(F.col("place") <= F.col("size") - F.ceil(F.lit(share) * F.col("size")) + 1).select("value", "id")


def star_pairs(lists: DataFrame) -> DataFrame:
    """Each id of a list with the list's least: (a, b), a < b, once each."""
    least = lists.groupBy("value").agg(F.min("id").alias("a"))
    return lists.join(least, "value").select("a", F.col("id").alias("b")).where("a < b").distinct()


def all_pairs(lists: DataFrame) -> DataFrame:
    """Every two ids of a list: (a, b), a < b, once each."""
    left, right = lists.withColumnRenamed("id", "a"), lists.withColumnRenamed("id", "b")
    return left.join(right, "value").where("a < b").select("a", "b").distinct()
