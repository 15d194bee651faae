"""Repeated passages as spans of words, shared by the two operators that find them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A passage counts when so many words in a row occur in two documents or more.
MIN_WORDS = 50


def several(rows: DataFrame, *key: str) -> DataFrame:
    """Rows whose key occurs with at least two doc_ids; ``first_doc`` is the least of them."""
    of = Window.partitionBy(*key)
    return rows.withColumn("first_doc", F.min("doc_id").over(of)).withColumn("__last", F.max("doc_id").over(of)).where("first_doc < __last").drop("__last")


def merged(ranges: DataFrame) -> DataFrame:
    """(doc_id, low, high, first_doc): windows starting at low..high -> maximal spans
    (doc_id, start_word, n_words, first_doc_id).  Spans that touch or overlap become one."""
    rows = ranges.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("low", "high", "first_doc"))).alias("r"))

    def join(batches):
        for batch in batches:
            column = batch.column("r")
            offs = column.offsets.to_numpy()
            flat = column.values
            low, high, first = (flat.field(k).to_numpy() for k in range(3))
            docs = batch.column("doc_id").to_numpy()
            low, high, first = low[offs[0] : offs[-1]], high[offs[0] : offs[-1]], first[offs[0] : offs[-1]]
            sizes = np.diff(offs)
            row = np.repeat(np.arange(len(docs)), sizes)
            if not len(row):
                continue
            # the furthest end so far within the document: rows are apart by more than any end
            wide = np.int64(int(high.max()) + MIN_WORDS + 1)
            reach = np.maximum.accumulate(row * wide + high + MIN_WORDS)
            fresh = np.ones(len(row), np.bool_)
            fresh[1:] = row[1:] * wide + low[1:] > reach[:-1]
            at = np.flatnonzero(fresh)
            last = np.append(at[1:], len(row)) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs[row[at]], pa.int64()), pa.array(low[at], pa.int32()),
                    pa.array(reach[last] - row[at] * wide - low[at], pa.int32()), pa.array(np.minimum.reduceat(first, at), pa.int64()),
                ],
                names=["doc_id", "start_word", "n_words", "first_doc_id"],
            )

    return rows.mapInArrow(join, "doc_id bigint, start_word int, n_words int, first_doc_id bigint")
