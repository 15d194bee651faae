"""Substring dedup with difference-cover anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, sieve, sifted, texts
from .spans import MIN_WORDS, merged, several
from .text import Words, chunks, span_hashes

#: A difference cover: every residue is the difference of two members, so for any two positions there
#: is a shift below PERIOD that brings both onto the cover.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Words in an anchor.  A match of WIDTH + PERIOD - 1 = MIN_WORDS words has an anchor at the same place of both.
WIDTH = MIN_WORDS - PERIOD + 1
_ON = np.zeros(PERIOD, np.bool_)
_ON[list(COVER)] = True


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, place, anchor): hashes of the WIDTH words from each cover position of documents that
    have MIN_WORDS words or more."""

    def make(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                number = np.diff(words.offsets)
                # no window runs over a document's end
                room = np.where(number >= MIN_WORDS, number - WIDTH + 1, 0)
                row = np.repeat(np.arange(len(number)), room)
                place = np.arange(len(row)) - np.repeat(np.cumsum(room) - room, room)
                on = _ON[place % PERIOD]
                row, place = row[on], place[on]
                at = words.offsets[row] + place
                hashes = span_hashes(words.hashes, at, at + WIDTH)
                ids = part.column("doc_id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(place, pa.int32()), pa.array(hashes.view(np.int64))], names=["doc_id", "place", "anchor"])

    return texts(docs).mapInArrow(make, "doc_id bigint, place int, anchor bigint")


def windows_near(found: DataFrame) -> DataFrame:
    """(doc_id, low, window): hashes of the MIN_WORDS-word windows that contain a shared anchor whole.

    ``found``: (doc_id, text, places)."""

    def extend(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                column = part.column("places")
                offs = column.offsets.to_numpy()
                places = column.values.to_numpy()[offs[0] : offs[-1]]
                row = np.repeat(np.arange(part.num_rows), np.diff(offs))
                # marks of all starts that an anchor allows: [place - (MIN_WORDS - WIDTH), place]
                begin, end = words.offsets[row], words.offsets[row + 1]
                low = np.maximum(begin + places - (MIN_WORDS - WIDTH), begin)
                high = np.minimum(begin + places, end - MIN_WORDS)
                good = high >= low
                edge = np.zeros(len(words.hashes) + 2, np.int64)
                np.add.at(edge, low[good], 1)
                np.add.at(edge, high[good] + 1, -1)
                start = np.flatnonzero(np.cumsum(edge) > 0)
                hashes = span_hashes(words.hashes, start, start + MIN_WORDS)
                of = np.searchsorted(words.offsets, start, "right") - 1
                ids = part.column("doc_id").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[of]), pa.array(start - words.offsets[of], pa.int32()), pa.array(hashes.view(np.int64))], names=["doc_id", "low", "window"]
                )

    return found.mapInArrow(extend, "doc_id bigint, low int, window bigint")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id): the maximal spans of words that are covered by
    passages of MIN_WORDS words or more which another document has too; first_doc_id is the least
    document that shares a passage of the span (the span is the first copy where it is doc_id itself).

    An anchor shared by two documents proves nothing yet: the windows of MIN_WORDS words around it are
    hashed in each document and compared across all documents, so a passage with thousands of copies
    costs its length in every copy, not a number of pairs.  Passages that repeat within one document
    alone don't count, and rows that repeat a doc_id are one document.  Null texts are empty; texts of
    fewer than MIN_WORDS words have no spans; null doc_ids are left out; an empty table gives an empty
    result.  Ties can't arise."""
    shared = cut(several(anchors(docs), "anchor").groupBy("doc_id").agg(F.collect_set("place").alias("places")))
    # texts that surely have no shared anchor aren't moved
    asked = sifted(texts(docs), sieve(shared, "doc_id"), "doc_id").where("__maybe").drop("__maybe")
    windows = windows_near(asked.join(shared, "doc_id").select("doc_id", "text", "places"))
    hits = several(windows, "window")
    return merged(hits.select("doc_id", "low", F.col("low").alias("high"), "first_doc"))
