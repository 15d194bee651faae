"""Quality classifier: Bradley-Terry pairwise ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, texts
from .text import Words, chunks, span_hashes

FEATURES = (
    "upper_share", "digit_share", "symbol_share", "pipe_share", "stop_mark_share", "space_share", "other_share",
    "log_words", "word_length", "distinct_words", "distinct_lines", "line_length", "marks_a_word", "capital_words",
)
#: Words are hashed to so many more features: the root of the share of the text's words that fall there.
WORD_FEATURES = 64
WIDTH = len(FEATURES) + WORD_FEATURES
_CLASSES = ("A-Z", "0-9", "#$%&*@~^<>{}[]=+_\\/`", "|", "!?", " \t\n\r")


def _class_table() -> np.ndarray:
    table = np.full(256, len(_CLASSES), np.int8)
    table[97:123] = table[128:] = -1
    table[65:91], table[48:58] = 0, 1
    for k, signs in enumerate(_CLASSES[2:], 2):
        for s in signs:
            table[ord(s)] = k
    return table


_TABLE = _class_table()


def features(column: pa.Array) -> np.ndarray:
    """One row for every text: FEATURES, then WORD_FEATURES for what its words are."""
    raw = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(raw, pa.ChunkedArray):
        raw = raw.combine_chunks()
    n = len(raw)
    offs = np.frombuffer(raw.buffers()[1], np.int64, n + 1, raw.offset * 8)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offs[0] : offs[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    size = np.maximum(np.diff(offs), 1)
    kind = _TABLE[data]
    out = np.zeros((n, WIDTH))

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[offs[1:]] - total[offs[:-1]]

    counts = [count(kind == k) for k in range(len(_CLASSES) + 1)]
    words = Words(column)
    number = np.diff(words.offsets)
    some = np.maximum(number, 1)
    row = np.repeat(np.arange(n), number)
    length = np.bincount(row, words.end - words.begin, n)
    order = np.lexsort((words.hashes, row))
    h, r = words.hashes[order], row[order]
    fresh = np.ones(len(h), np.bool_)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[fresh], minlength=n)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))[: len(starts)]
    line_row = np.searchsorted(offs, starts, "right") - 1
    line_hash = span_hashes(data, starts, ends - (data[ends - 1] == 10)) if len(starts) else np.zeros(0, np.uint64)
    lines = np.bincount(line_row, minlength=n)
    order = np.lexsort((line_hash, line_row))
    h, r = line_hash[order], line_row[order]
    fresh = np.ones(len(h), np.bool_)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    for k, c in enumerate((*counts[:2], *counts[2:5], counts[5], counts[6])):
        out[:, k] = c / size
    out[:, 7] = np.log1p(number)
    out[:, 8] = length / some
    out[:, 9] = (distinct / some) * np.log1p(number)
    out[:, 10] = np.bincount(r[fresh], minlength=n) / np.maximum(lines, 1)
    out[:, 11] = np.log1p(size / np.maximum(lines, 1))
    out[:, 12] = np.minimum((counts[2] + counts[3] + counts[4]) / some, 5)
    out[:, 13] = counts[0] / some
    place = row * WORD_FEATURES + (words.hashes >> np.uint64(32)).astype(np.int64) % WORD_FEATURES
    out[:, len(FEATURES) :] = np.sqrt(np.bincount(place, minlength=n * WORD_FEATURES).reshape(n, WORD_FEATURES) / some[:, None])
    return out


def fit(x: np.ndarray, good: np.ndarray, pairs: int, seed: int, rounds: int = 30, ridge: float = 1e-3) -> dict:
    """Weights w that maximise the mean of log sigmoid(w . (x_good - x_bad)) over seeded pairs."""
    centre = x.mean(0) if len(x) else np.zeros(WIDTH)
    scale = x.std(0) if len(x) else np.ones(WIDTH)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - centre) / scale
    w = np.zeros(WIDTH)
    up, down = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if len(up) and len(down):
        rng = np.random.default_rng(seed)
        diff = z[rng.choice(up, pairs)] - z[rng.choice(down, pairs)]
        for _ in range(rounds):  # Newton's steps; the loss is convex
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            gradient = diff.T @ p / pairs - ridge * w
            hessian = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
    return {"weights": w, "centre": centre, "scale": scale}


def score_udf(model: dict):
    """An Arrow function text -> score, for select()."""
    weights, centre = model["weights"] / model["scale"], model["centre"]

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], names=["text"])
        parts = [(features(part.column(0)) - centre) @ weights for part in chunks(batch, "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, pairs: int = 50_000, seed: int = 17) -> dict:
    """Fits the ranking on at most ``max_labelled`` labelled documents (those with the least hash of
    their id) and at most ``pairs`` seeded preference pairs: any document of quality 1 is preferred to
    any of quality 0.  A document that is labelled twice is of quality 1 if any label says so."""
    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_labelled)
    labelled = texts(docs).join(F.broadcast(chosen), "doc_id")  # no more than max_labelled rows of two numbers

    def extract(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"]
                )

    rows = labelled.mapInArrow(extract, "doc_id bigint, quality int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), WIDTH)
    good = rows["quality"].to_numpy()
    model = fit(x, good, pairs, seed)
    return model | {"junk_share": rejected((x - model["centre"]) @ (model["weights"] / model["scale"]), good)}


def rejected(scores: np.ndarray, good: np.ndarray) -> float:
    """The share of the labelled documents below the score that parts the labels with the fewest errors (ties: the
    least score); 0 without labels of both kinds."""
    if not len(scores) or good.min() == good.max():
        return 0.0
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    # n documents are rejected: the good ones among them and the others' bad ones are errors
    errors = np.concatenate([[0], np.cumsum(g)]) + np.concatenate([np.cumsum((1 - g)[::-1])[::-1], [0]])
    edge = np.r_[True, s[1:] > s[:-1], True]  # equal scores go together
    return float(np.flatnonzero(edge)[np.argmin(errors[edge])] / len(s))


def threshold(scores: DataFrame, model: dict) -> float:
    """The least score that is kept: the quantile of all documents' scores (column __gl_score) at the share that is
    rejected of the labelled ones."""
    if not model["junk_share"]:
        return float("-inf")
    level = scores.agg(F.percentile_approx("__gl_score", float(model["junk_share"]), 100_000)).first()[0]
    return float("-inf") if level is None else float(level)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that score at least the threshold, with all their columns.

    Null and empty texts are scored like any other (as a text of no words).  Rows without a doc_id are
    scored and kept or rejected by their text too.  Ties with the threshold are kept; repeated rows are
    judged alike.  Without labels of both kinds nothing is rejected.  An empty table gives an empty one."""
    model = train(docs, labels)
    score, text = score_udf(model), F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the threshold follows from all scores; to score again takes less than to write all documents in between
    least = threshold(docs.select(score(text).alias("__gl_score")), model)
    return docs.where(score(text) >= least)


def ranked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, threshold) of the documents that are kept; see keep()."""
    model = train(docs, labels)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    scored = cut(docs.select("doc_id", score_udf(model)(text).alias("__gl_score")))
    least = threshold(scored, model)
    return scored.where(F.col("__gl_score") >= least).select("doc_id", F.col("__gl_score").alias("score"), F.lit(least).alias("threshold"))
