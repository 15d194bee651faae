"""Vectorised word hashing shared by the operators of this subpackage.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the
lower-cased text (Arrow's ``utf8_lower``); everything else separates words.  Words are handled
as 64-bit hashes computed straight from the Arrow string buffers with numpy: no Python object
is made per word, and a text is always processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time (a longer single text is still taken whole).
CHUNK_BYTES = 2_000_000

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_WORD = np.zeros(256, np.bool_)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True

def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser; a bijection of uint64."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values.  (np.unique without counts hashes, which takes far longer here.)"""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class _Powers:
    """Powers of the hash's base and of its inverse, as many as were needed so far in this process."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def __reduce__(self):
        return (_Powers, ())  # made anew in each worker, not sent

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                up, down = (np.full(max(n, 1 << 16), x, np.uint64) for x in (_P, _P_INV))
                up[0] = down[0] = 1
                self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every span, the same wherever the span lies.

    A polynomial prefix sum modulo 2**64, so the cost does not depend on the spans' lengths."""
    up, down = _POWERS.first(len(values) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values + np.uint64(1)) * up[: len(values)], out=prefix[1:])
        out = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(out)


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of the given width; empty when the array is shorter."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return span_hashes(values, at, at + width)


class Words:
    """The words of a chunk of texts.  ``hashes[offsets[i]:offsets[i+1]]`` are those of text i;
    ``begin``/``end`` are their byte positions in ``data``, the lower-cased bytes of all texts."""

    __slots__ = ("begin", "data", "end", "hashes", "offsets", "text_offsets")

    def __init__(self, texts: pa.Array):
        texts = pc.utf8_lower(pc.fill_null(texts, ""))
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        n = len(texts)
        buffers = texts.buffers()
        offs = np.frombuffer(buffers[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(buffers[2], np.uint8) if n and buffers[2] is not None else np.zeros(0, np.uint8)
        self.data = raw[offs[0] : offs[-1]]
        self.text_offsets = offs - offs[0]
        # a separator is put between texts, so that no word runs over a border
        size = len(self.data)
        inside = np.zeros(size + 2, np.bool_)
        inside[1:-1] = _WORD[self.data]
        edge = inside[1:] != inside[:-1]
        inner = self.text_offsets[1:-1]
        inner = inner[(inner > 0) & (inner < size)]
        split = inner[inside[inner] & inside[inner + 1]]
        bounds = np.flatnonzero(edge)
        if len(split):
            split = np.unique(split)
            bounds = np.sort(np.concatenate([bounds, split, split]))
        self.begin, self.end = bounds[0::2], bounds[1::2]
        self.offsets = np.searchsorted(self.begin, self.text_offsets)
        self.hashes = span_hashes(self.data, self.begin, self.end)


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of about CHUNK_BYTES of text; a row is never divided."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths, dtype=np.int64) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def reference_words(text: str | None) -> list[str]:
    """The words of one text in plain Python, for brute-force checks."""
    out, word = [], []
    for ch in (text or "").lower():
        if ch >= "\x80" or ch.isalnum():
            word.append(ch)
        elif word:
            out.append("".join(word))
            word = []
    return [*out, "".join(word)] if word else out
