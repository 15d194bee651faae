"""Near-duplicate documents by bottom-k sketches from one hash function."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, sieve, sifted, texts
from .components import components
from .overlap import all_pairs, prefix_lists, star_pairs
from .text import Words, chunks, windows

#: Words in a shingle; values kept of each document; documents at least this alike are near copies.
SHINGLE, KEPT, ALIKE = 3, 64, 0.5
#: The estimate from sketches may be lower than ALIKE by this (two standard errors at KEPT values).
MARGIN = 0.125


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one document; a shorter document is one shingle, an empty one none."""
    if len(hashes) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(windows(hashes, min(SHINGLE, len(hashes))))


def bottom(values: np.ndarray, k: int = KEPT) -> np.ndarray:
    """The k least distinct values, sorted; sorts only about k of them."""
    n = len(values)
    if n > 4 * k:
        limit = np.uint64(int((k + 6 * k**0.5 + 8) / n * 2**64))
        low = np.unique(values[values < limit])
        if len(low) >= k:
            return low[:k]
    return np.unique(values)[:k]


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, text, body): body is the hash of the text, so that rows that repeat a doc_id with another text differ."""
    return texts(docs).withColumn("body", F.unhex(F.md5("text")))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, body, values): each row's version and its bottom-k sketch."""

    def make(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                h, offs = words.hashes, words.offsets
                shingles = windows(h, SHINGLE)
                values, sizes = [], np.zeros(len(offs), np.int64)
                for i in range(len(offs) - 1):
                    a, b = offs[i], offs[i + 1]
                    kept = bottom(shingles[a : b - SHINGLE + 1]) if b - a >= SHINGLE else shingle_set(h[a:b])
                    values.append(kept)
                    sizes[i + 1] = len(kept)
                flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("body"), lists], names=["doc_id", "body", "values"])

    return versions(docs).mapInArrow(make, "doc_id bigint, body binary, values array<bigint>")


def estimate(a: np.ndarray, b: np.ndarray, k: int = KEPT) -> float:
    """Jaccard similarity from two sketches: the share of the union's k least values that both have."""
    if not len(a) or not len(b):
        return 0.0
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return np.searchsorted(both, union[-1], "right") / len(union)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offs = column.offsets.to_numpy(zero_copy_only=False)
    return column.values.to_numpy(zero_copy_only=False).view(np.uint64), offs


def likely(pairs: DataFrame, sketch: DataFrame, least: float) -> DataFrame:
    """Of (a, b), the pairs that the union sketch puts at ``least`` or more."""
    left = sketch.select(F.col("id").alias("a"), F.col("values").alias("va"))
    right = sketch.select(F.col("id").alias("b"), F.col("values").alias("vb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb")

    def judge(batches):
        for batch in batches:
            (x, xo), (y, yo) = _lists(batch.column("va")), _lists(batch.column("vb"))
            good = [estimate(x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]]) >= least for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(judge, "a bigint, b bigint")


def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """(a, b, jaccard) of the pairs whose whole shingle sets are at least ALIKE.  bodies: (id, text)."""
    left = bodies.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = bodies.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")

    def judge(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sets: dict[int, np.ndarray] = {}
                for name, text in (("a", "ta"), ("b", "tb")):
                    ids = part.column(name).to_numpy()
                    _, first = np.unique(ids, return_index=True)
                    fresh = np.array([i for i in first if int(ids[i]) not in sets], np.int64)
                    words = Words(part.column(text).take(pa.array(fresh)))
                    for n, i in enumerate(fresh):
                        sets[int(ids[i])] = shingle_set(words.hashes[words.offsets[n] : words.offsets[n + 1]])
                out = []
                for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    out.append(both / max(len(sets[a]) + len(sets[b]) - both, 1))
                result = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(out, pa.float64())], names=["a", "b", "jaccard"])
                yield result.filter(pa.array(np.array(out) >= ALIKE))

    return joined.mapInArrow(judge, "a bigint, b bigint, jaccard double")


def standing(docs: DataFrame) -> DataFrame:
    """(body, id, doc_id, values): every text once, with a number of its own, its least doc_id and its sketch."""
    made = sketches(docs).where(F.size("values") > 0).groupBy("body").agg(F.min("doc_id").alias("doc_id"), F.any_value("values").alias("values"))
    return cut(made.select("body", F.monotonically_increasing_id().alias("id"), "doc_id", "values"))


def links(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): pairs of near copies among the standing texts that join all that are near copies of each other."""
    lists = cut(prefix_lists(distinct.select("id", "values"), ALIKE - MARGIN))
    # from here on only texts that are in a list matter
    listed = cut(distinct.join(lists.select("id").distinct(), "id", "left_semi"))
    sketch = listed.select("id", "values")
    rows = sifted(versions(docs), sieve(listed, "doc_id", "body"), "doc_id", "body").where("__maybe").drop("__maybe")
    bodies = cut(rows.join(listed.select("id", "doc_id", "body"), ["doc_id", "body"]).dropDuplicates(["doc_id", "body"]).select("id", "text"))
    first = cut(verified(likely(star_pairs(lists), sketch, ALIKE - MARGIN), bodies).select("a", "b"))
    joined = cut(components(first))
    labelled = lists.join(joined, "id", "left").select("value", "id", F.coalesce("root", "id").alias("root"))
    several = labelled.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("value")
    mixed = cut(labelled.join(several, "value", "left_semi"))
    left, right = mixed.select("value", F.col("id").alias("a"), F.col("root").alias("ra")), mixed.select("value", F.col("id").alias("b"), F.col("root").alias("rb"))
    rest = left.join(right, "value").where("a < b and ra <> rb").select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    return first.union(verified(likely(rest, sketch, ALIKE - MARGIN), bodies).select("a", "b"))


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, body, times): how often each version occurs."""
    return cut(versions(docs).groupBy("doc_id", "body").agg(F.count(F.lit(1)).alias("times")))


def classes(docs: DataFrame, own: DataFrame) -> DataFrame:
    """(body, root, keeper, keeper_body, copies, twice): every text that has a copy or near copy, with its group; twice says
    if a version of the text is repeated.  own: members(docs)."""
    distinct = standing(docs)
    joined = components(links(distinct, docs))
    number = own.groupBy("body").agg(F.count(F.lit(1)).alias("n"), F.max("times").alias("times"))
    rooted = distinct.select("body", "id", "doc_id").join(joined, "id", "left").join(number, "body").select("body", "doc_id", "n", "times", F.coalesce("root", "id").alias("root"))
    rooted = cut(rooted)
    whole = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "body")).alias("keeper"), F.sum("n").alias("copies"))
    told = rooted.join(whole, "root").where("copies > 1 or times > 1")
    return told.select("body", "root", F.col("keeper.doc_id").alias("keeper"), F.col("keeper.body").alias("keeper_body"), "copies", (F.col("times") > 1).alias("twice"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keeper, copies): every document that has a near copy, the least doc_id of its group and
    the group's number of documents.

    A group is a connected component of the pairs whose 3-word shingle sets have a Jaccard similarity of
    ALIKE or more.  Exact copies (the same text) are joined by its hash first and one
    stands for them; every other text is compared through the inverted lists of its retained values.
    In a list each text is held against the list's least first, which joins most of a large group
    with few pairs; only texts still in different groups are then compared two by two.  Pairs that the union sketches
    put more than MARGIN below ALIKE are not verified: of pairs exactly at ALIKE about one in fifty is lost by that, of
    those above 0.6 none that counts.

    Texts without words have no copies.  Null texts are empty, rows with a null doc_id are left
    out.  Rows that repeat a doc_id with the same text are one document; with different texts they are documents of
    their own, each with its own group (a row for each group of the doc_id).  Ties
    can't arise: the least doc_id stays, of several texts of it the one of the least hash.  An empty table gives an empty result."""
    own = members(docs)
    return own.join(classes(docs, own).where("copies > 1"), "body").select("doc_id", "keeper", "copies", "root").distinct().drop("root")


def pairs(docs: DataFrame) -> DataFrame:
    """(a, b, jaccard) of all verified pairs of different texts, each by its least doc_id, for tests and reports."""
    distinct = standing(docs)
    sketch = distinct.select("id", "values")
    bodies = versions(docs).join(distinct.select("id", "doc_id", "body"), ["doc_id", "body"]).dropDuplicates(["doc_id", "body"]).select("id", "text")
    made = verified(likely(all_pairs(prefix_lists(sketch, ALIKE - MARGIN)), sketch, ALIKE - MARGIN), bodies)
    name = distinct.select("id", "doc_id")
    named = made.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of groups(), that of the least doc_id; all columns stay.

    Rows that repeat a doc_id with the same text are copies too and one stays, that of the least other columns (those that
    have an order); with different texts that aren't near copies all stay.  Rows with a null doc_id can't be told
    apart and all stay, as do all rows whose text has no words."""
    drop = classes(docs, members(docs)).select(F.col("body").alias("__gl_body"), F.col("keeper").alias("__gl_keeper"), (F.col("body") == F.col("keeper_body")).alias("__gl_own"), F.col("twice").alias("__gl_twice"))
    drop = cut(drop)
    keyed = docs.withColumns({"__gl_body": F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))), "__gl_doc": F.col("doc_id").cast("bigint")})
    # rows that surely have no copy aren't moved
    keyed = sifted(keyed, sieve(drop, "__gl_body"), "__gl_body")
    asked = F.col("__maybe") & F.col("__gl_doc").isNotNull()
    kept = keyed.where(asked).join(drop, "__gl_body", "left").where("__gl_keeper is null or (__gl_own and __gl_doc = __gl_keeper)")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    repeats = F.coalesce(F.col("__gl_twice"), F.lit(False))
    order = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant", "interval", "calendarinterval")]
    one = kept.where(repeats).groupBy("__gl_body", "__gl_doc").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__gl_row"))
    return keyed.where(~asked).select(*columns).unionByName(kept.where(~repeats).select(*columns)).unionByName(one.select("__gl_row.*"))
