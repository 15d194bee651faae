"""Suffix-array dedup by column-wise construction of a collection's Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, sieve, sifted, texts
from .spans import MIN_WORDS, merged
from .text import Words, chunks, mix, span_hashes

#: Words in a minimiser.  Equal passages of MIN_WORDS words have the same least one, so they meet in its bucket.
SEED_WORDS = 12
#: Symbols of whole buckets that are built together.
BATCH_SYMBOLS = 60_000


def build(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, lcp, bwt) of all suffixes of a collection in lexicographic order.

    ``symbols``: the strings one after another (integers >= 0), string k at offsets[k]:offsets[k+1].
    Each round puts one more symbol in front of every string, right to left: its new suffix is placed
    among the old ones by the symbol and the place of the suffix that it extends (the LF mapping of
    the transform so far), and the common prefix with either neighbour is one more than the least common
    prefix between the places that the two extend.  A round reads the transform, the common prefixes
    and the order once from front to end and writes the next ones the same way: they are the sequential
    files of the method, as columns of a task's memory.  Ends of strings are equal and sort first."""
    count = len(offsets) - 1
    length = np.diff(offsets)
    top = int(length.max()) if count else 0
    # the order: the empty suffixes first.  key = symbol << 32 | place of the extended suffix; ends have -1.
    string = np.arange(count, dtype=np.int32)
    size = np.zeros(count, np.int32)
    key = np.full(count, -1, np.int64)
    lcp = np.zeros(count, np.uint16)
    place = np.arange(count)
    active = np.flatnonzero(length > 0)
    for j in range(1, top + 1):
        active = active[length[active] >= j]
        n = len(key)
        new_key = (symbols[offsets[active + 1] - j].astype(np.int64) << 32) | place[active]
        order = np.argsort(new_key, kind="stable")
        who, new_key = active[order], new_key[order]
        at = np.searchsorted(key, new_key)  # ends come first, as they are -1
        spot = at + np.arange(len(at))  # in the new order
        # common prefixes, from the old ones
        tables = [lcp]
        while (1 << len(tables)) <= n:
            half = 1 << (len(tables) - 1)
            tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))

        def between(a: np.ndarray, b: np.ndarray, tables=tables) -> np.ndarray:
            """One more than the least lcp of the old places a+1..b (a < b)."""
            out = np.zeros(len(a), np.int64)
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            for k in np.unique(level):
                m = level == k
                t = tables[k]
                out[m] = np.minimum(t[a[m] + 1], t[b[m] - (1 << int(k)) + 1])
            return out + 1

        total = n + len(at)
        keep = np.ones(total, np.bool_)
        keep[spot] = False
        fresh = np.empty(total, np.int64)
        fresh[keep], fresh[spot] = key, new_key
        low = np.int64(0xFFFFFFFF)
        merged_lcp = np.empty(total, np.uint16)
        merged_lcp[keep] = lcp
        before = fresh[spot - 1]  # spot >= count, so there is one
        same = (before >> 32) == (new_key >> 32)
        value = np.zeros(len(spot), np.int64)
        value[same] = between(before[same] & low, new_key[same] & low)
        merged_lcp[spot] = value
        after = spot + 1
        ok = after < total
        ok[ok] &= keep[after[ok]]  # a new neighbour has got its own
        ok[ok] &= (fresh[after[ok]] >> 32) == (new_key[ok] >> 32)
        merged_lcp[after[ok]] = between(new_key[ok] & low, fresh[after[ok]] & low)
        lcp = merged_lcp
        # places move on by what was put before them
        moved = np.flatnonzero(keep)
        ends = fresh < 0
        key = (fresh & ~low) | moved[np.where(ends, 0, fresh & low)]
        key[ends] = -1
        for old, value in (("string", who.astype(np.int32)), ("size", np.full(len(who), j, np.int32))):
            column = np.empty(total, np.int32)
            column[keep], column[spot] = (string if old == "string" else size), value
            if old == "string":
                string = column
            else:
                size = column
        place[who] = spot
    start = length[string] - size if count else np.zeros(0, np.int64)
    head = offsets[string] + start - 1 if count else np.zeros(0, np.int64)
    bwt = np.where(start > 0, symbols[np.maximum(head, 0)] if len(symbols) else -1, -1) if count else np.zeros(0, np.int64)
    return string, start, lcp, bwt


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, text, version): rows that repeat a doc_id with another text differ in version."""
    return texts(docs).withColumn("version", F.xxhash64("text"))


def super_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, version, start, number, bucket, content): runs of ``number`` windows of MIN_WORDS words from word
    ``start`` on whose least minimiser is the same one; content is the hash of all the run's words."""
    span = MIN_WORDS - SEED_WORDS + 1

    def make(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                h, offs = words.hashes, words.offsets
                seeds = len(h) - SEED_WORDS + 1
                if seeds < span:
                    continue
                at = np.arange(seeds)
                # a seed's hash with its place in the low bits can't be used: equal words must choose alike
                value = mix(span_hashes(h, at, at + SEED_WORDS))
                least, width = value, 1
                while width * 2 <= span:
                    least = np.minimum(least[: len(least) - width], least[width:])
                    width *= 2
                least = np.minimum(least[: seeds - span + 1], least[span - width : seeds - width + 1])
                number = np.diff(offs)
                own = np.repeat(np.arange(len(number)), np.maximum(number - MIN_WORDS + 1, 0))
                if not len(own):
                    continue
                room = np.maximum(number - MIN_WORDS + 1, 0)
                start = np.arange(len(own)) - np.repeat(np.cumsum(room) - room, room)
                bucket = least[offs[own] + start]
                cutting = np.ones(len(own), np.bool_)
                cutting[1:] = (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1])
                # a seed that comes again at once would make a run longer than a window holds: cut there
                first = np.flatnonzero(cutting)
                run = np.diff(np.append(first, len(own)))
                if run.max() > span:
                    extra = [np.arange(f + span, f + r, span) for f, r in zip(first[run > span], run[run > span], strict=True)]
                    first = np.sort(np.concatenate([first, *extra]))
                    run = np.diff(np.append(first, len(own)))
                begin = offs[own[first]] + start[first]
                content = span_hashes(h, begin, begin + run + MIN_WORDS - 1)
                ids = part.column("doc_id").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[own[first]]), pa.array(part.column("version").to_numpy()[own[first]]), pa.array(start[first], pa.int32()),
                        pa.array(run, pa.int32()), pa.array(bucket[first].view(np.int64)), pa.array(content.view(np.int64)),
                    ],
                    names=["doc_id", "version", "start", "number", "bucket", "content"],
                )

    return versions(docs).mapInArrow(make, "doc_id bigint, version bigint, start int, number int, bucket bigint, content bigint")


def symbols_of(found: DataFrame) -> DataFrame:
    """(bucket, content, least, most, words) from (text, runs)."""

    def make(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                column = part.column("runs")
                offs = column.offsets.to_numpy()
                flat = column.values
                start, number, bucket, content, least, most = (flat.field(k).to_numpy()[offs[0] : offs[-1]] for k in range(6))
                begin = words.offsets[np.repeat(np.arange(part.num_rows), np.diff(offs))] + start
                length = number.astype(np.int64) + MIN_WORDS - 1
                ends = np.concatenate([[0], np.cumsum(length)])
                at = np.arange(ends[-1]) - np.repeat(ends[:-1] - begin, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array(content), pa.array(least), pa.array(most), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words.hashes[at].view(np.int64)))],
                    names=["bucket", "content", "least", "most", "words"],
                )

    return found.mapInArrow(make, "bucket bigint, content bigint, least bigint, most bigint, words array<bigint>")


def _hits(bucket: np.ndarray, least: np.ndarray, most: np.ndarray, words: np.ndarray, offsets: np.ndarray):
    """(string, low, high, first_doc): runs of suffix starts whose first MIN_WORDS words another document has."""
    # a bucket's number in front keeps buckets apart; only suffixes of MIN_WORDS words or more can tie
    _, symbol = np.unique(words, return_inverse=True)
    group = np.repeat(np.unique(bucket, return_inverse=True)[1], np.diff(offsets))
    _, symbol = np.unique(group.astype(np.int64) * (len(words) + 1) + symbol, return_inverse=True)
    string, start, lcp, _ = build(symbol, offsets)
    head = np.flatnonzero(lcp < MIN_WORDS)  # a new set of suffixes that agree in MIN_WORDS words
    one, other = np.minimum.reduceat(least[string], head), np.maximum.reduceat(most[string], head)
    sizes = np.diff(np.append(head, len(lcp)))
    good = np.repeat(one < other, sizes) & (np.diff(offsets)[string] - start >= MIN_WORDS)
    s, a, first = string[good], start[good], np.repeat(one, sizes)[good]
    order = np.lexsort((a, s))
    s, a, first = s[order], a[order], first[order]
    fresh = np.ones(len(s), np.bool_)
    fresh[1:] = (s[1:] != s[:-1]) | (a[1:] != a[:-1] + 1)
    at = np.flatnonzero(fresh)
    if not len(at):
        return s, a, a, first
    return s[at], a[at], a[np.append(at[1:], len(s)) - 1], np.minimum.reduceat(first, at)


def shared_runs(strings: DataFrame) -> DataFrame:
    """(bucket, content, low, high, first_doc) from whole buckets of strings; see _hits()."""
    schema = pa.schema([("bucket", pa.int64()), ("content", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("first_doc", pa.int64())])

    def solve(batch: pa.Table) -> pa.RecordBatch:
        batch = batch.combine_chunks()
        column = batch.column("words").combine_chunks()
        offs = column.offsets.to_numpy().astype(np.int64)
        words = column.values.to_numpy()[offs[0] : offs[-1]]
        get = lambda name: batch.column(name).to_numpy()
        bucket, content = get("bucket"), get("content")
        s, low, high, first = _hits(bucket, get("least"), get("most"), words, offs - offs[0])
        return pa.RecordBatch.from_arrays([pa.array(bucket[s]), pa.array(content[s]), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(first)], schema=schema)

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        held, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            offs = batch.column("words").offsets.to_numpy()
            breaks = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(bucket)]
            at = 0
            for low, high in zip(breaks, breaks[1:], strict=False):
                if held >= BATCH_SYMBOLS and bucket[low] != last:
                    if low > at:
                        waiting.append(batch.slice(at, low - at))
                    yield solve(pa.Table.from_batches(waiting))
                    waiting, held, at = [], 0, low
                held += int(offs[high] - offs[low])
                last = bucket[high - 1]
            waiting.append(batch.slice(at))
        if waiting:
            yield solve(pa.Table.from_batches(waiting))

    return strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket bigint, content bigint, low int, high int, first_doc bigint")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id): the maximal spans of words covered by passages of
    MIN_WORDS words or more which another document has too; first_doc_id is the least document that
    shares a passage of the span.

    Suffixes are compared over MIN_WORDS words, so the collection is divided by minimisers first: a
    window of MIN_WORDS words belongs to the bucket of its least SEED_WORDS-word hash, consecutive
    windows of a bucket form one short string, and a string that several documents have is taken once.
    Buckets that one document alone has can't hold a passage of two and are left out.  Every other
    bucket's strings, of at most 2 * MIN_WORDS words, are a collection whose transform and common
    prefixes are built column by column (build()).  Passages that repeat within one document alone don't
    count; rows that repeat a doc_id are one document.  Null texts are empty, shorter texts have no
    spans, null doc_ids are left out, an empty table gives an empty result.  Ties can't arise."""
    of_bucket, of_content = Window.partitionBy("bucket"), Window.partitionBy("bucket", "content")
    runs = (
        super_windows(docs)
        .withColumn("least", F.min("doc_id").over(of_bucket)).withColumn("most", F.max("doc_id").over(of_bucket)).where("least < most")
        .withColumn("least", F.min("doc_id").over(of_content)).withColumn("most", F.max("doc_id").over(of_content))
        .withColumn("chosen", F.row_number().over(of_content.orderBy("doc_id", "start")) == 1)
    )
    runs = cut(runs)
    fields = ("start", "number", "bucket", "content", "least", "most")
    chosen = runs.where("chosen").groupBy("doc_id", "version").agg(F.collect_list(F.struct(*fields)).alias("runs"))
    # texts of which no string is taken aren't moved
    asked = sifted(versions(docs), sieve(runs.where("chosen"), "doc_id", "version"), "doc_id", "version").where("__maybe").drop("__maybe")
    joined = asked.join(chosen, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"])
    found = shared_runs(symbols_of(joined.select("text", "runs")))
    # strings of several documents are repeated from end to end; others where the common prefixes say so
    whole = runs.where("least < most").select("doc_id", F.col("start").alias("low"), (F.col("start") + F.col("number") - 1).alias("high"), F.col("least").alias("first_doc"))
    part = runs.select("doc_id", "start", "bucket", "content").join(found, ["bucket", "content"])
    part = part.select("doc_id", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"), "first_doc")
    return merged(whole.union(part))
