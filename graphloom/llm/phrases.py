"""Document fingerprints from Lempel-Ziv phrases."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, texts
from .text import Words, chunks, mix

#: Minimum hashes in a signature; fingerprints that agree in this share of them or more are alike.
HASHES, ALIKE = 48, 0.5
#: The signature's places are dealt into one group less than the equal hashes that ALIKE needs, so two of those lie in
#: one group.  A band is two places of a group: signatures that are alike agree in a whole band, always.
_GROUPS = np.array_split(np.random.default_rng(47).permutation(HASHES), math.ceil(ALIKE * HASHES) - 1)
_BANDS = np.array([pair for group in _GROUPS for pair in combinations(group, 2)])
#: In an order in which a band and the two before it have six places; those before each, and the places that none of the three has.
_BANDS = _BANDS[np.arange(len(_BANDS)) * 10 % len(_BANDS)]
_BEFORE = np.hstack([np.roll(_BANDS, 1, axis=0), np.roll(_BANDS, 2, axis=0)])
_REST = np.array([np.setdiff1d(np.arange(HASHES), [*own, *before]) for own, before in zip(_BANDS, _BEFORE, strict=True)])
_ODD = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1))[:, None]
_MASK = (1 << 61) - 1


def parse(words: list[int]) -> set[int]:
    """Hashes of the phrases of a Lempel-Ziv 78 parse: each phrase is the longest one met before and
    one word more.  The last phrase may be one met before and adds nothing."""
    known: set[int] = set()
    phrase = 0
    for w in words:
        phrase = (phrase * 1000003 + w) & _MASK
        if phrase not in known:
            known.add(phrase)
            phrase = 0
    return known


def signatures(phrases: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of HASHES minima for each set of phrases (offsets as usual; no set may be empty), of each its low 16 bits:
    two that differ agree in those once in 65 536 times."""
    out = np.empty((len(offsets) - 1, HASHES), np.uint16)
    mixed = mix(phrases.astype(np.uint64))
    with np.errstate(over="ignore"):
        for j in range(HASHES):
            out[:, j] = np.minimum.reduceat(((mixed * _ODD[j]) >> np.uint64(32)).astype(np.uint32), offsets[:-1]).astype(np.uint16)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, phrases, signature): the number of distinct phrases and the minimum hashes of their set.
    A text without words has no phrases and no signature (null)."""

    def make(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                short = (words.hashes & np.uint64(0x7FFFFFFF)).astype(np.int64) + 1
                offs = words.offsets
                sets = [parse(short[offs[i] : offs[i + 1]].tolist()) for i in range(part.num_rows)]
                sizes = np.array([len(s) for s in sets])
                some = sizes > 0
                signed = np.zeros((0, HASHES), np.uint16)
                if some.any():
                    flat = np.fromiter((x for s in sets for x in s), np.uint64, int(sizes.sum()))
                    signed = signatures(flat, np.concatenate([[0], np.cumsum(sizes[some])]))
                number = np.zeros(part.num_rows + 1, np.int64)
                number[1:] = np.cumsum(some * HASHES)
                lists = pa.ListArray.from_arrays(pa.array(number, pa.int32(), mask=np.append(~some, False)) if len(some) else pa.array([0], pa.int32()), pa.array(signed.reshape(-1).view(np.int16)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int32()), lists], names=["doc_id", "phrases", "signature"])

    return texts(docs).mapInArrow(make, "doc_id bigint, phrases int, signature array<smallint>")


def banded(standing: DataFrame) -> DataFrame:
    """(band, id, n0, n1, n2): every band's hash of (id, signature), with the four values of the two bands before it, whole, in n0 and
    the low three bits of the other 42 in n1 and n2, whose signs tell that there is a band before it, and a second.

    Equal values have equal low bits, so two rows with fewer than ALIKE * HASHES equal ones of those can't be
    alike; of two random values only one in 8 agrees.  And rows that agree in a band before this one meet there.  So pairs
    are judged in the join, before they move, and move from few of the bands that they share."""

    def make(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("signature")
            signed = column.flatten().to_numpy(zero_copy_only=False).view(np.uint16).astype(np.uint64).reshape(-1, HASHES)
            times = len(_BANDS)
            with np.errstate(over="ignore"):
                band = mix(mix(signed[:, _BANDS[:, 0]]) + signed[:, _BANDS[:, 1]])
                band = mix(band + np.arange(times, dtype=np.uint64)[None, :])
                whole = np.bitwise_or.reduce(signed[:, _BEFORE] << (np.arange(4, dtype=np.uint64) * np.uint64(16)), axis=2)
                bits = np.bitwise_or.reduce((signed & np.uint64(7))[:, _REST].reshape(-1, times, 2, 21) << (np.arange(21, dtype=np.uint64) * np.uint64(3)), axis=3)
                bits |= (np.arange(times)[:, None] > np.arange(2)).astype(np.uint64) << np.uint64(63)
            small = [x.reshape(-1).view(np.int64) for x in (whole, *np.ascontiguousarray(np.moveaxis(bits, 2, 0)))]
            ids = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(band.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, times)), *map(pa.array, small)],
                names=["band", "id", "n0", "n1", "n2"],
            )

    return standing.mapInArrow(make, "band bigint, id bigint, n0 bigint, n1 bigint, n2 bigint")


def candidates(standing: DataFrame) -> DataFrame:
    """(a, b), a < b: standing documents with an equal band that may be alike, once each; those of an a lie together."""
    rows = banded(standing)
    left = rows.select("band", F.col("id").alias("a"), *[F.col(f"n{k}").alias(f"x{k}") for k in range(3)])
    right = rows.select("band", F.col("id").alias("b"), *[F.col(f"n{k}").alias(f"y{k}") for k in range(3)])

    x0, x1, x2 = (F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}")) for k in range(3))

    def same(x, bits: int, at: int):
        return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << bits) - 1)) == 0

    def equal(x):
        some = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.lit(21) - F.bit_count(some.bitwiseAND(F.lit(sum(1 << 3 * k for k in range(21)))))

    number = F.lit(2) + equal(x1) + equal(x2) + sum(same(x0, 16, 16 * k).cast("int") for k in range(4))
    before = (F.col("x1") < 0) & same(x0, 32, 0) | (F.col("x2") < 0) & same(x0, 32, 32)
    return left.join(right, "band").where((F.col("a") < F.col("b")) & ~before & (number >= int(ALIKE * HASHES))).select("a", "b").repartition("a").distinct()


def alike(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copies, links, match_id, similarity): every document whose fingerprint is like another's.

    Documents with the very same signature are a class: class_id is the least of them, copies their number.  links is
    the number of other documents whose signatures agree with the document's in ALIKE of the minimum hashes or more, its
    own class among them; match_id is the class of the best match among other classes (the class itself where no other
    is alike) and similarity the share of equal minimum hashes with it, an estimate of the Jaccard similarity of the
    phrase sets (ties: the least class).  So there is one row a document, and thousands of copies
    aren't told pair by pair.  Classes are compared where one of their bands is equal, as in every pair with ALIKE or
    more equal hashes one is (see _BANDS): no link is missed or capped.

    Texts without words match nothing.  Null texts are empty, rows with a null doc_id are left out, of rows that repeat
    a doc_id the signature with the least hash counts.  An empty table gives an empty result."""
    signed = fingerprints(docs).where("signature is not null").select("doc_id", "signature", F.xxhash64("signature").alias("h1"), F.xxhash64("signature", F.lit(1)).alias("h2"))
    signed = cut(signed)
    # copies are found by the hashes alone; signatures move once, and only those that stand for others
    own = signed.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("doc_id", "h.h1", "h.h2")
    classes = cut(own.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    # written, so that both sides of the bands' join read one exchange of them
    standing = cut(signed.join(classes.select(F.col("id").alias("doc_id"), "h1", "h2", "copies"), ["doc_id", "h1", "h2"]).dropDuplicates(["doc_id", "h1", "h2"]).select(F.col("doc_id").alias("id"), "signature", "copies"))
    pairs = candidates(standing.select("id", "signature"))
    left = standing.select(F.col("id").alias("a"), F.col("signature").alias("x"), F.col("copies").alias("na"))
    right = standing.select(F.col("id").alias("b"), F.col("signature").alias("y"), F.col("copies").alias("nb"))
    equal = F.aggregate(F.zip_with("x", "y", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, k: n + k)
    judged = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", equal.alias("equal")).where(F.col("equal") >= math.ceil(ALIKE * HASHES))
    ends = judged.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other"), F.col("nb").alias("n"), "equal"), F.struct(F.col("b").alias("id"), F.col("a").alias("other"), F.col("na").alias("n"), "equal"))))
    # equal hashes first, then the least other class: one number and one id, summed where the pairs lie
    linked = ends.groupBy("id").agg(F.sum("n").alias("n"), F.max(F.struct("equal", (-F.col("other")).alias("least"))).alias("best"))
    told = classes.join(linked, "id", "left").where("copies > 1 or n is not null")
    told = told.select(
        "h1", "h2", F.col("id").alias("class_id"), "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"),
        F.coalesce(-F.col("best.least"), F.col("id")).alias("match_id"), F.coalesce(F.col("best.equal") / F.lit(float(HASHES)), F.lit(1.0)).alias("similarity"),
    )
    return own.join(told, ["h1", "h2"]).drop("h1", "h2")
