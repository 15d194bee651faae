"""Benchmark decontamination by latent semantic retrieval and longest common subsequences."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Sent, cut, texts
from .text import Words, chunks, distinct

#: Words in a passage of a benchmark item at most; items of fewer than SHORT words are found only where all of
#: their words stand in a row.
PASSAGE, SHORT = 48, 8
#: Documents are searched in windows of two blocks, one block apart.
BLOCK = 32
#: Dimensions of the latent space, extra ones while it is found, rounds of the iteration, and the places that words
#: are hashed to, so that the axes have one size whatever the vocabulary.
RANK, EXTRA, ROUNDS, PLACES = 96, 8, 3, 1 << 16
#: Passages of documents that a task multiplies in a round, and about how many of them at once; places that at least one
#: in OFTEN of these have, and words that one in OFTEN blocks of documents have, are multiplied as dense columns.
PASSAGES, GROUP, OFTEN = 200_000, 1_000, 128
#: Candidates: windows whose latent cosine with a passage is COSINE, and those that have OVERLAP of its words.
COSINE, OVERLAP = 0.6, 0.4
#: A leak: the common subsequence is VERBATIM of the passage, or PARAPHRASE of it with ANSWER of its last ANSWER_WORDS words
#: and, as words that all texts have agree by chance, WEIGHT of the passage by TF-IDF.
VERBATIM, PARAPHRASE, ANSWER, ANSWER_WORDS, WEIGHT = 0.75, 0.5, 0.75, 8, 0.4
#: Words of the benchmark that are held and sent at once; a larger one goes in parts, one in memory at a time, with the
#: same results.  Distinct words that are sent at once, likewise.
PART_WORDS, TERMS_AT_ONCE = 1_000_000, 8_000_000


def places_of(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(48)).astype(np.int64) % PLACES


class Axes:
    """The latent space: a row of ``values`` for each place that the vocabulary uses; ``row_of`` finds it."""

    def __init__(self, used: np.ndarray, values: np.ndarray):
        self.row_of = np.full(PLACES, -1, np.int32)
        self.row_of[used] = np.arange(len(used))
        self.values = values.astype(np.float32)

    def rows(self, terms: np.ndarray) -> np.ndarray:
        return self.row_of[places_of(terms)]


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """Inverse document frequencies, never 0: a word that all documents have counts a little too."""
    return np.log(1 + (documents + 1) / (df + 1.0))


class Part:
    """Passages of the benchmark with the inverted lists that find them.

    A passage of L words is looked for in windows that have words which make up OVERLAP of it (all of it where it is
    short).  Who has that much has half as much among all but the most frequent words, so only those need lists."""

    def __init__(self, item: np.ndarray, words: list[np.ndarray], df: list[np.ndarray], short: np.ndarray, documents: int):
        self.item, self.short = item, short
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.terms, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
        count = (np.concatenate(df) if df else np.zeros(0))[first]
        self.idf = weights(count, documents).astype(np.float32)
        ends = np.cumsum([0, *map(len, words)])
        self.passages = [inverse[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        self.enough, self.first_of = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        owner, term, weight, cells, times, answers = [], [], [], [], [], []
        for n, p in enumerate(self.passages):
            own, number = np.unique(p, return_counts=True)
            cells.append(own + n * len(self.terms))
            times.append(number)
            answers.append(np.bincount(np.searchsorted(own, p[-ANSWER_WORDS:]), minlength=len(own)))
            self.enough[n] = len(p) if short[n] else math.ceil(OVERLAP * len(p))
            self.first_of[n] = (self.enough[n] + 1) // 2
            order = np.argsort(count[own], kind="stable")
            own, number = own[order], number[order]
            # what is left out weighs enough - first_of at most
            listed = np.cumsum(number[::-1])[::-1] > self.enough[n] - self.first_of[n]
            owner.append(np.full(int(listed.sum()), n))
            term.append(own[listed])
            weight.append(number[listed])
        owner, term, weight, self.cells, self.times, self.answers = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, term, weight, cells, times, answers))
        # a cell is a word of a passage: how often it is there, how often in the answer, and its TF-IDF weight
        self.weights = self.times * self.idf[self.cells % max(len(self.terms), 1)].astype(np.float64)
        self.weight = np.bincount(self.cells // max(len(self.terms), 1), self.weights, len(words))
        self.marks = np.zeros(1 << (8 * len(self.cells)).bit_length(), np.bool_)
        self.marks[self.cells & (len(self.marks) - 1)] = True
        order = np.argsort(term, kind="stable")
        self.holders, self.heavy = owner[order], weight[order].astype(np.float64)
        self.lists = np.searchsorted(term[order], np.arange(len(self.terms) + 1))

    def project(self, axes: Axes) -> None:
        """The passages in the latent space."""
        place = axes.rows(self.terms)
        z = np.zeros((len(self.passages), axes.values.shape[1]), np.float32)
        for n, p in enumerate(self.passages):
            z[n] = (self.idf[p, None] * axes.values[place[p]]).sum(0)
        self.latent = z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each element of a."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    state = full
    for y in b:
        hit = state & where.get(y, 0)
        if hit:
            state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def _cells(part: Part, block: np.ndarray, term: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, term), each once, in order: what a window's two blocks hold."""
    cell = distinct(block * len(part.terms) + term)
    block, term = cell // len(part.terms), cell % len(part.terms)
    back = (block > 0) & pair[np.maximum(block - 1, 0)]
    cell = distinct(np.concatenate([cell, (block[back] - 1) * len(part.terms) + term[back]]))
    return cell // len(part.terms), cell % len(part.terms)


def _by_words(part: Part, window: np.ndarray, term: np.ndarray):
    """Arrays (window, passage) of the passages of whose listed words a window has enough, some windows at a time."""
    size = part.lists[term + 1] - part.lists[term]
    ends = np.cumsum(size)
    low = 0
    while low < len(window):
        # whole windows, of about 100 000 entries of the lists
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + 100_000, "right"))
        high = int(np.searchsorted(window, window[min(max(high, low + 1), len(window)) - 1], "right"))
        n = size[low:high]
        of = np.repeat(np.arange(low, high), n)
        entry = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + part.lists[term[of]]
        first, passages = int(window[low]), len(part.passages)
        key = (window[of] - first) * passages + part.holders[entry]
        if (int(window[high - 1]) - first + 1) * passages <= 4_000_000:
            weight = np.bincount(key, part.heavy[entry], (int(window[high - 1]) - first + 1) * passages)
            found = np.flatnonzero((weight.reshape(-1, passages) >= np.maximum(part.first_of, 1)).ravel())
        else:
            found, inverse = np.unique(key, return_inverse=True)
            found = found[np.bincount(inverse, part.heavy[entry]) >= part.first_of[found % passages]]
        yield found // passages + first, found % passages
        low = high


def _overlap(part: Part, passage: np.ndarray, begin: np.ndarray, end: np.ndarray, term: np.ndarray, *measures: np.ndarray) -> list[np.ndarray]:
    """Of each passage, the sums of the measures (a number for each cell) over those of its words that are of the terms at
    begin:end.  By part.times it is how many words are there: no common subsequence is longer."""
    out = [np.zeros(len(passage)) for _ in measures]
    for low in range(0, len(passage), 4_000):
        b, size = begin[low : low + 4_000], (end - begin)[low : low + 4_000]
        at = np.arange(size.sum()) + np.repeat(b - np.cumsum(size) + size, size)
        cell = np.repeat(passage[low : low + 4_000] * len(part.terms), size) + term[at]
        maybe = np.flatnonzero(part.marks[cell & (len(part.marks) - 1)])
        place = np.searchsorted(part.cells, cell[maybe])
        place[place == len(part.cells)] = 0
        good = part.cells[place] == cell[maybe]
        seen = distinct(np.repeat(np.arange(len(b)), size)[maybe[good]] * len(part.cells) + place[good])
        which, place = seen // len(part.cells), seen % len(part.cells)
        for sums, measure in zip(out, measures, strict=True):
            sums[low : low + 4_000] = np.bincount(which, measure[place], len(b))
    return out


def _matched(words: Words, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of words, their terms) for words that are among the terms (sorted hashes)."""
    if not len(terms) or not len(words.hashes):
        return (np.zeros(0, np.int64),) * 2
    maybe = np.zeros(1 << 20, np.bool_)
    maybe[(terms & np.uint64(0xFFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(maybe[(words.hashes & np.uint64(0xFFFFF)).astype(np.int64)])
    k = np.searchsorted(terms, words.hashes[at])
    k[k == len(terms)] = 0
    hit = terms[k] == words.hashes[at]
    return at[hit], k[hit]


def _layers(x: np.ndarray, size: int = 4_000):
    """Slices of the places of x (values in runs), each with a value once at most: the first of every run, then the second, and so on."""
    heads = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(heads, len(x)))
    rank = np.arange(len(x)) - np.repeat(heads, lengths)
    order, low = np.argsort(rank.astype(np.min_scalar_type(int(lengths.max(initial=0)))), kind="stable"), 0
    for number in np.bincount(rank).tolist():
        for a in range(low, low + number, size):
            yield order[a : min(a + size, low + number)]
        low += number


class Windows:
    """The windows of a chunk of texts: two blocks in a row make one, unless the second belongs to the next text."""

    def __init__(self, words: Words):
        self.words, number = words, np.diff(words.offsets)
        self.blocks = (number + BLOCK - 1) // BLOCK
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])
        self.pair = np.ones(self.first[-1], np.bool_)
        self.pair[self.first[1:][self.blocks > 0] - 1] = False
        self._last = None

    def matched(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_matched(), kept for the next call: a benchmark in one part has the vocabulary's terms."""
        if self._last is None or not np.array_equal(self._last[0], terms):
            self._last = (terms, *_matched(self.words, terms))
        return self._last[1:]

    def block_of(self, at: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(self.blocks)), np.diff(self.words.offsets))[at]
        return self.first[row] + (at - self.words.offsets[row]) // BLOCK

    def fold(self, vocabularies: list, axes: Axes) -> np.ndarray:
        """Every window in the latent space: the sum of its words that the benchmark has anywhere, of length 1."""
        full = np.zeros((self.first[-1], axes.values.shape[1]), np.float32)
        for v in vocabularies:
            terms, idf = v.value
            at, k = self.matched(terms)
            block, place = self.block_of(at), axes.rows(terms)
            # words that many blocks have, as a dense matrix of how often, some blocks at a time
            often = np.flatnonzero(np.bincount(k, minlength=len(terms)) * OFTEN >= max(len(full), 1))
            column = np.full(len(terms), -1)
            column[often] = np.arange(len(often))
            column = column[k]
            many, vectors = np.flatnonzero(column >= 0), idf[often, None] * axes.values[place[often]]
            step = max(1, 200_000 // max(len(often), 1))
            for low in range(0, len(full), step):
                high = min(low + step, len(full))
                a, z = np.searchsorted(block[many], [low, high])
                some = many[a:z]
                times = np.bincount((block[some] - low) * len(often) + column[some], minlength=(high - low) * len(often))
                full[low:high] = full[low:high] + times.reshape(high - low, len(often)).astype(np.float32) @ vectors
            few = np.flatnonzero(column < 0)
            block, k = block[few], k[few]
            for some in _layers(block):
                full[block[some]] += idf[k[some], None] * axes.values[place[k[some]]]
            _forget(vocabularies, v)
        both = full.copy()
        joined = np.flatnonzero(self.pair)
        both[joined] += full[joined + 1]
        return both / np.maximum(np.linalg.norm(both, axis=1), 1e-9)[:, None]


def _forget(sent: list, one) -> None:
    """Where several things are sent, one is in memory at a time."""
    if len(sent) > 1:
        one.forget()


def find(windows: Windows, part: Part, both: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float, int]]:
    """(row, item_id) -> (common share, answer share, cosine, first word) of the best leak.  both: windows.fold()."""
    out: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    words, blocks, first, pair = windows.words, windows.blocks, windows.first, windows.pair
    at, k = windows.matched(part.terms)
    if not len(at) or not len(part.passages):
        return out
    block = windows.block_of(at)
    window, term = _cells(part, block, k, pair)
    cells_from = np.searchsorted(window, np.arange(first[-1] + 1))
    passages = len(part.passages)
    found = []
    for b, p in _by_words(part, window, term):
        good = _overlap(part, p, cells_from[b], cells_from[b + 1], term, part.times)[0] >= part.enough[p]
        found.append(b[good] * passages + p[good])
    step = max(1, 400_000 // passages)
    for low in range(0, len(both), step):
        b, p = np.nonzero(both[low : low + step] @ part.latent.T >= COSINE)
        found.append((b + low) * passages + p)
    found = distinct(np.concatenate(found))
    b, p = found // passages, found % passages
    # the words around the window are judged with it
    row_of = np.repeat(np.arange(len(blocks)), blocks)[b]
    start = words.offsets[row_of] + (b - first[row_of]) * BLOCK
    begin = np.maximum(start - BLOCK // 2, words.offsets[row_of])
    end = np.minimum(start + 2 * BLOCK + BLOCK // 2, words.offsets[row_of + 1])
    length = np.array([len(x) for x in part.passages])
    a, z = np.searchsorted(at, begin), np.searchsorted(at, end)
    # only what the words alone allow is judged in their order; weights a little below, as they are added up in another order
    shared, answered, weight = _overlap(part, p, a, z, k, part.times, part.answers, part.weights)
    reworded = (shared >= PARAPHRASE * length[p]) & (answered >= ANSWER * np.minimum(ANSWER_WORDS, length[p])) & (weight >= 0.999 * WEIGHT * part.weight[p])
    maybe = np.where(part.short[p], shared >= length[p], (shared >= VERBATIM * length[p]) | reworded)
    for c in np.flatnonzero(maybe):
        passage, n = part.passages[p[c]].tolist(), int(p[c])
        region = k[a[c] : z[c]].tolist()
        if part.short[n]:
            # in a row, with no other word between
            hits = at[a[c] : z[c]]
            m = len(passage)
            share = float(any(region[x : x + m] == passage and hits[x + m - 1] - hits[x] == m - 1 for x in range(len(region) - m + 1)))
        else:
            share = common_subsequence(passage, region) / len(passage)
        answer, have = passage[-ANSWER_WORDS:], set(region)
        answered = sum(x in have for x in answer) / len(answer)
        if share >= VERBATIM or (share >= PARAPHRASE and answered >= ANSWER and sum(part.idf[x] for x in passage if x in have) >= WEIGHT * sum(part.idf[x] for x in passage)):
            best = (share, answered, round(float(both[b[c]] @ part.latent[n]), 4), int(begin[c] - words.offsets[row_of[c]]))
            key = (int(row_of[c]), int(part.item[n]))
            if key not in out or best > out[key]:
                out[key] = best
    return out


def passages(benchmark: DataFrame) -> DataFrame:
    """(item_id, short, words): every item's words (hashes), in passages of at most PASSAGE."""

    def divide(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                number = np.diff(words.offsets)
                pieces = np.maximum(-(-number // PASSAGE), 1)
                row = np.repeat(np.arange(part.num_rows), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                ends = words.offsets[row] + (piece + 1) * number[row] // pieces[row]
                cuts = pa.array(np.r_[0, ends], pa.int32())
                short = pa.array((number < SHORT)[row])
                lists = pa.ListArray.from_arrays(cuts, pa.array(words.hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(row)), short, lists], names=["item_id", "short", "words"])

    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return items.mapInArrow(divide, "item_id bigint, short boolean, words array<bigint>").where("size(words) > 0")


def scanned(docs: DataFrame, slices: list) -> DataFrame:
    """(term, df, ends, words) in one pass: of each task's documents, how many have each term of the vocabulary; and, in other
    rows, the terms' numbers in every passage of the documents that has any (bytes of int32; ends: where the passages end).

    slices: the vocabulary's terms (sorted hashes), sent in parts, numbered one part after the other."""

    def scan(batches):
        df = [None] * len(slices)
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                places, numbers, start = [], [], 0
                for n, sent in enumerate(slices):
                    terms = sent.value
                    at, k = _matched(words, terms)
                    if df[n] is None:
                        df[n] = np.zeros(len(terms), np.int64)
                    if len(at):
                        row = np.searchsorted(words.offsets, at, "right") - 1
                        df[n] += np.bincount(distinct(row * len(terms) + k) % len(terms), minlength=len(terms))
                    places.append(at)
                    numbers.append(k + start)
                    start += len(terms)
                    _forget(slices, sent)
                at, numbers = np.concatenate(places), np.concatenate(numbers)
                if not len(at):
                    continue
                if len(slices) > 1:
                    order = np.argsort(at, kind="stable")
                    at, numbers = at[order], numbers[order]
                # as passages() divides a text
                length = np.diff(words.offsets)
                pieces = -(-length // PASSAGE)
                row = np.searchsorted(words.offsets, at, "right") - 1
                passage = np.cumsum(pieces)[row] - pieces[row] + ((at - words.offsets[row] + 1) * pieces[row] - 1) // length[row]
                ends = np.append(np.flatnonzero(passage[1:] != passage[:-1]) + 1, len(passage))
                packed = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (ends, numbers)]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *packed], names=["term", "df", "ends", "words"])
        for sent, counted in zip(slices, df, strict=True):
            if counted is not None:
                at = np.flatnonzero(counted)
                terms = sent.value[at].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counted[at]), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary())], names=["term", "df", "ends", "words"])
                _forget(slices, sent)

    return texts(docs).mapInArrow(scan, "term bigint, df bigint, ends binary, words binary")


def _unit_rows(row: np.ndarray, place: np.ndarray, weight: np.ndarray, number: int, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, weight) with the weights of a row's place added up and those of a row made of length 1, by row and place."""
    cell = row * np.int64(wide) + place
    order = np.argsort(cell, kind="stable")
    cell, weight = cell[order], weight[order]
    head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    weight = np.add.reduceat(weight, head) if len(head) else weight
    row, place = cell[head] // wide, cell[head] % wide
    norm = np.sqrt(np.bincount(row, weight * weight, number))
    return row, place, weight / np.maximum(norm[row], 1e-12)


_PACKED = "number int, ends binary, places binary, weights binary"


def _pack(row: np.ndarray, place: np.ndarray, weight: np.ndarray, number: int) -> pa.RecordBatch:
    """Rows of a matrix in one record: where they end, their places (65 536 at most) and weights."""
    parts = np.searchsorted(row, np.arange(number), "right").astype(np.int32), place.astype(np.uint16), weight.astype(np.float32)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=["number", "ends", "places", "weights"])


def _grouped(row: np.ndarray, place: np.ndarray, weight: np.ndarray, number: int):
    """The rows in parts of GROUP, with their numbers; rows whose most frequent place is the same lie together, as texts of a
    language do, so that a part has fewer places and more of them are in many of its rows."""
    count = np.bincount(place)
    rank = np.empty_like(count)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    least = np.full(number, len(count))
    np.minimum.at(least, row, rank[place])
    new = np.empty(number, np.int64)
    new[np.argsort(least, kind="stable")] = np.arange(number)
    row = new[row]
    order = np.argsort(row, kind="stable")
    row, place, weight = row[order], place[order], weight[order]
    for low in range(0, number, GROUP):
        high = min(low + GROUP, number)
        a, z = np.searchsorted(row, [low, high])
        yield row[a:z] - low, place[a:z], weight[a:z], high - low


def document_rows(scan: DataFrame, vocabularies: list, used: np.ndarray) -> DataFrame:
    """Packed rows of TF-IDF, of length 1, for every passage that scanned() found."""
    axes = Axes(used, np.zeros((len(used), 0)))
    finder = Sent(scan.sparkSession, axes)

    def make(batches):
        for batch in batches:
            for ends, words in zip(batch.column("ends"), batch.column("words"), strict=True):
                ends, numbers = np.frombuffer(ends.as_py(), np.int32), np.frombuffer(words.as_py(), np.int32)
                place, weight, start = np.zeros(len(numbers), np.int64), np.zeros(len(numbers)), 0
                for v in vocabularies:
                    terms, idf = v.value
                    mine = np.flatnonzero((numbers >= start) & (numbers < start + len(terms)))
                    k = numbers[mine] - start
                    place[mine], weight[mine] = finder.value.rows(terms)[k], idf[k]
                    start += len(terms)
                    _forget(vocabularies, v)
                row = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
                for part in _grouped(*_unit_rows(row, place, weight, len(ends), len(used)), len(ends)):
                    yield _pack(*part)

    return scan.where("ends is not null").select("ends", "words").mapInArrow(make, _PACKED)


def orthogonal(block: np.ndarray) -> np.ndarray:
    """An orthonormal base of the columns' span, by the small square matrix of their products; columns that are spare are 0."""
    values, vectors = np.linalg.eigh(block.T @ block)
    good = values > max(values.max(), 1e-300) * 1e-12
    return block @ (vectors * np.where(good, 1 / np.sqrt(np.where(good, values, 1)), 0))


def latent_axes(rows: DataFrame, used: np.ndarray, seed: int = 5, documents: DataFrame | None = None, scale: float = 1.0) -> Axes:
    """Leading right singular vectors of a TF-IDF matrix A, by randomised subspace iteration.

    ``rows``: (words array<bigint>, idf array<double>, scale double), a row of A each, which is made of length ``scale``;
    ``documents``: more rows, packed, each made of length ``scale``.  Each
    round multiplies a block of vectors by A'A: partitions give their rows' share, summed by place; the driver makes
    the block orthogonal.  The block has RANK + EXTRA numbers for each place that is used, PLACES at most, whatever there is
    of rows and words."""
    width = RANK + EXTRA
    finder = Sent(rows.sparkSession, Axes(used, np.zeros((len(used), 0))))

    def pack(batches):
        for batch in batches:
            column = batch.column("words")
            offs = column.offsets.to_numpy()
            place = finder.value.rows(column.values.to_numpy()[offs[0] : offs[-1]].view(np.uint64))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offs))
            row, place, weight = _unit_rows(row, place, batch.column("idf").flatten().to_numpy(), batch.num_rows, len(used))
            yield _pack(row, place, weight * batch.column("scale").to_numpy()[row], batch.num_rows)

    packed = cut(rows.mapInArrow(pack, _PACKED)).withColumn("square", F.lit(1.0))
    if documents is not None:
        packed = packed.union(documents.withColumn("square", F.lit(scale * scale)))

    def times(block: np.ndarray) -> np.ndarray:
        sent = Sent(rows.sparkSession, block.astype(np.float32))

        def share(batches):
            block, total = sent.value, np.zeros((len(used), width))
            for batch in batches:
                for record in batch.to_pylist():
                    number = record["number"]
                    ends, place, weight = (np.frombuffer(record[c], t) for c, t in (("ends", np.int32), ("places", np.uint16), ("weights", np.float32)))
                    row = np.repeat(np.arange(number), np.diff(np.append(0, ends)))
                    # columns that many rows have, as a dense matrix; the others entry by entry
                    often = np.flatnonzero(np.bincount(place, minlength=len(used)) * OFTEN >= max(number, 1))
                    column = np.full(len(used), -1)
                    column[often] = np.arange(len(often))
                    column = column[place]
                    dense = np.zeros((number, len(often)), np.float32)
                    many = np.flatnonzero(column >= 0)
                    dense[row[many], column[many]] = weight[many]
                    latent = dense @ block[often]
                    few = np.flatnonzero(column < 0)
                    row, place, weight = row[few], place[few], weight[few, None]
                    for some in _layers(row):
                        latent[row[some]] += weight[some] * block[place[some]]
                    total[often] += record["square"] * (dense.T @ latent)
                    order = np.argsort(place, kind="stable")
                    row, place, weight = row[order], place[order], record["square"] * weight[order]
                    for some in _layers(place):
                        total[place[some]] += weight[some] * latent[row[some]]
            at = np.flatnonzero(np.abs(total).sum(1))
            ends = np.arange(len(at) + 1, dtype=np.int32) * width
            for low in range(0, len(at), 4096):
                some = at[low : low + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.ListArray.from_arrays(pa.array(ends[: len(some) + 1]), pa.array(total[some].ravel()))], names=["place", "value"])

        def add(batches):
            for batch in batches:
                column = batch.column("values")  # of each place, its rows of all partitions
                offs = column.offsets.to_numpy()
                flat = column.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                if batch.num_rows:
                    value = np.add.reduceat(flat, offs[:-1] - offs[0], axis=0)
                    ends = np.arange(len(value) + 1, dtype=np.int32) * width
                    yield pa.RecordBatch.from_arrays([batch.column("place"), pa.ListArray.from_arrays(pa.array(ends), pa.array(value.ravel()))], names=["place", "value"])

        shares = packed.mapInArrow(share, "place int, value array<double>").groupBy("place").agg(F.collect_list("value").alias("values"))
        summed = shares.mapInArrow(add, "place int, value array<double>").toArrow()
        out = np.zeros_like(block)
        if summed.num_rows:
            out[summed.column("place").to_numpy()] = summed.column("value").combine_chunks().flatten().to_numpy().reshape(-1, width)
        sent.destroy()
        return out

    block = orthogonal(np.random.default_rng(seed).standard_normal((len(used), width)))
    for _ in range(ROUNDS):
        block = orthogonal(times(block))
    small = block.T @ times(block)
    _, vectors = np.linalg.eigh((small + small.T) / 2)
    return Axes(used, block @ vectors[:, ::-1][:, :RANK])


def prepare(docs: DataFrame, benchmark: DataFrame) -> tuple[list, list, object]:
    """(parts, vocabularies, axes), broadcast: the benchmark's passages with document frequencies counted over all
    documents, its terms with their weights, and the latent space, which is the same however many parts there are."""
    spark = docs.sparkSession
    divided = cut(passages(benchmark).withColumn("n", F.monotonically_increasing_id()))
    vocabulary = divided.select(F.explode("words").alias("term")).distinct()
    number = texts(docs).count()
    slices, terms = [], vocabulary.count()
    pieces = max(1, -(-terms // TERMS_AT_ONCE))
    for k in range(pieces):
        some = vocabulary.where(F.pmod(F.xxhash64("term"), F.lit(pieces)) == k).toArrow().column("term").to_numpy().view(np.uint64)
        slices.append(Sent(spark, np.sort(some)))
    scan = cut(scanned(docs, slices))
    frequencies = scan.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(1 + (F.lit(number) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0))
    known = cut(vocabulary.join(frequencies, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"), idf.alias("idf")))
    placed = divided.select("n", "item_id", "short", F.posexplode("words").alias("at", "term")).join(known, "term")
    ordered = placed.groupBy("n", "item_id", "short").agg(F.sort_array(F.collect_list(F.struct("at", "term", "df", "idf"))).alias("w"))
    ready = cut(ordered.select("n", "item_id", "short", F.col("w.term").alias("words"), F.col("w.df").alias("df"), F.col("w.idf").alias("idf")))
    total, every = ready.agg(F.sum(F.size("words")), F.count(F.lit(1))).first()
    if not total:
        return [], [], Sent(spark, Axes(np.zeros(0, np.int64), np.zeros((0, 1))))
    used = np.sort(known.select((F.shiftrightunsigned("term", 48) % PLACES).cast("int").alias("place")).distinct().toArrow().column("place").to_numpy())
    vocabularies = []
    for k in range(len(slices)):
        table = known.where(F.pmod(F.xxhash64("term"), F.lit(len(slices))) == k).select("term", "idf").toArrow()
        terms, idf = table.column("term").to_numpy().view(np.uint64), table.column("idf").to_numpy()
        order = np.argsort(terms)  # as in slices
        vocabularies.append(Sent(spark, (terms[order], idf[order].astype(np.float32))))
    documents = cut(document_rows(scan, vocabularies, used))
    drawn = documents.agg(F.sum("number")).first()[0] or 0
    # a task's share is as large as the vocabulary, so there are as few of them as the passages allow
    documents = documents.coalesce(max(spark.sparkContext.defaultParallelism, -(-drawn // PASSAGES)))
    # both kinds of rows have the same weight in all
    rows = ready.select("words", "idf", F.lit(1.0).alias("scale"))
    axes = latent_axes(cut(rows.repartition(max(1, min(512, total // 200_000)))), used, documents=documents, scale=math.sqrt(every / max(drawn, 1)))
    parts, pieces = [], -(-total // PART_WORDS)
    for k in range(pieces):
        table = ready.where(F.pmod(F.xxhash64("n"), F.lit(pieces)) == k).orderBy("item_id", "n").toArrow().combine_chunks()
        words, df = (table.column(c).combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int64())) for c in ("words", "df"))
        part = Part(table.column("item_id").to_numpy(), [x.values.to_numpy().view(np.uint64) for x in words], [x.values.to_numpy() for x in df], table.column("short").to_numpy(zero_copy_only=False).astype(bool), number)
        part.project(axes)
        parts.append(Sent(spark, part))
    return parts, vocabularies, Sent(spark, axes)


def _search(column: pa.Array, parts: list, vocabularies: list, axes) -> dict[tuple[int, int], tuple[float, float, float, int]]:
    windows, out = Windows(Words(column)), {}
    if not parts or not len(windows.words.hashes):
        return out
    both = windows.fold(vocabularies, axes.value)
    for p in parts:
        for key, found in find(windows, p.value, both).items():
            if key not in out or found > out[key]:
                out[key] = found
        _forget(parts, p)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, kind, common_share, answer_share, cosine, start_word): every document that holds a
    benchmark item's passage, with the passage's best match.

    The latent space is the leading singular vectors of TF-IDF passages, the benchmark's and those of all documents, in
    the benchmark's words, with the frequencies of all documents.  Every window of two blocks of every document is folded
    into it; candidates are the passages whose cosine with it is COSINE, and, so that none is lost whose words are there,
    those of whose words it has OVERLAP, as inverted lists tell exactly.  The longest common subsequence with the words around
    decides: ``verbatim``, or ``paraphrase`` if the passage's last words (its answer) and WEIGHT of it by TF-IDF are there too.  Items of fewer
    than SHORT words leak only where all their words stand in a row.

    Null texts are empty and hold nothing; rows with a null doc_id are left out, as are items with a null
    item_id or without words; rows that repeat a doc_id or an item are told once each at
    most per row of documents, with the best match (ties: the later one).  Empty tables give an empty result."""
    ready = prepare(docs, benchmark)

    def search(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                found = sorted(_search(part.column("text"), *ready).items())
                ids = part.column("doc_id").to_pylist()
                columns = list(zip(*[(ids[r], i, "verbatim" if v[0] >= VERBATIM else "paraphrase", *v) for (r, i), v in found], strict=True)) or [[]] * 7
                types = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "kind", "common_share", "answer_share", "cosine", "start_word"])

    return texts(docs).mapInArrow(search, "doc_id bigint, item_id bigint, kind string, common_share double, answer_share double, cosine double, start_word int")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark passage (see leaks()); all columns stay.

    Each row is judged by its own text, without a join.  Null and empty texts stay, whatever the doc_id."""
    ready = prepare(docs, benchmark)

    @F.arrow_udf("boolean")
    def leaked(column: pa.Array) -> pa.Array:
        marks = [np.zeros(0, np.bool_)]
        for part in chunks(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
            mark = np.zeros(part.num_rows, np.bool_)
            for r, _ in _search(part.column("text"), *ready):
                mark[r] = True
            marks.append(mark)
        return pa.array(np.concatenate(marks))

    return docs.where(~leaked(F.coalesce(F.col("text").cast("string"), F.lit(""))))
