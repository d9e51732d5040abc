"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a text: hashed words, hashed pairs of neighbouring words, and hashed 1-, 2- and 3-grams of word *shapes*
(case, digits, length class and the punctuation at a word's end; a repeated word has a shape of its own). Each family is
averaged over the text, so a score is a sum of sparse dot products divided by the text's length.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RUN_BYTES, Memo, fold, kept, map_texts, small_batches, text_of, text_runs

HASH_BITS = 18
#: Most labelled rows that training takes, those of the lowest hash of their id.
TRAIN_ROWS = 6_000
THRESHOLD = 0.3
#: Families of features start at these offsets of the weight table: words and pairs, then shapes.
SHAPE_BITS = 14
SIZE = (1 << HASH_BITS) + (1 << SHAPE_BITS)
_TAIL = re.compile(rb"[^0-9A-Za-z\x80-\xff]*\Z")


def _shape(word: bytes) -> int:
    text = word.decode("utf-8", "replace")
    core = text.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    case = "0" if not core else "U" if core.isupper() and len(core) > 1 else "T" if core[0].isupper() else "l" if core.islower() else "m"
    digits = any(c.isdigit() for c in core)
    return zlib.crc32(f"{case}{digits:d}{min(len(core), 16) // 4}{_TAIL.search(word)[0].decode()}".encode())


def features(text: bytes, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers and their values; none for a text without words. Long texts are read in runs."""
    if len(text) > RUN_BYTES:
        counts, last = np.zeros(SIZE), []
        for run in text_runs(text):
            words = last + run.split()
            for numbers in _grams(words, memo, len(last)):
                counts += np.bincount(numbers, minlength=SIZE)
            last = words[-3:]
        distinct = np.flatnonzero(counts)
        lexical = distinct < 1 << HASH_BITS
        value = counts[distinct] / np.where(lexical, max(counts[: 1 << HASH_BITS].sum(), 1), max(counts[1 << HASH_BITS :].sum(), 1))
        return distinct.astype(np.int32), value.astype(np.float32)
    words = text.split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    lexical, shapes = _grams(words, memo)
    value = np.concatenate([np.full(len(lexical), 1 / len(lexical)), np.full(len(shapes), 1 / len(shapes))])
    distinct, where = np.unique(np.concatenate([lexical, shapes]), return_inverse=True)
    return distinct, np.bincount(where, value).astype(np.float32)


def _grams(words: list[bytes], memo: Memo, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the lexical and of the shape features that end after the first `known` words."""
    both = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    shape = np.where(np.fromiter((a == b for a, b in pairwise([b"", *words])), bool, len(words)), np.uint64(77), shape)
    mix = lambda a, b: (a * np.uint64(0x9E3779B1) + b) * np.uint64(0x85EBCA6B) >> np.uint64(7) & np.uint64(0xFFFFFFFF)
    pair = mix(shape[:-1], shape[1:])
    new, new_pair, new_trio = (slice(max(known - k, 0), None) for k in range(3))
    lexical = np.concatenate([word[new], mix(word[:-1], word[1:])[new_pair]]) & np.uint64((1 << HASH_BITS) - 1)
    shapes = np.concatenate([shape[new], pair[new_pair], mix(pair[:-1], shape[2:])[new_trio]]) & np.uint64((1 << SHAPE_BITS) - 1)
    return lexical.astype(np.int32), (shapes + np.uint64(1 << HASH_BITS)).astype(np.int32)


def new_memo() -> Memo:
    return Memo(lambda w: zlib.crc32(w.lower()) << 32 | _shape(w))


def shared_memo() -> Memo:
    """One memo for all tasks and batches of a worker."""
    return kept(("features",), new_memo)


@dataclass
class FtrlModel:
    """Weights of a trained classifier; `bias` is the score's log-odds of a text without words."""

    weights: np.ndarray
    bias: float

    def score(self, text: bytes, memo: Memo) -> float:
        at, value = features(text, memo)
        return float(1 / (1 + np.exp(-np.clip(self.bias + SCALE * (self.weights[at] @ value), -35, 35))))


#: Factor on the averaged features, so that a text's log-odds can move far within few updates.
SCALE = 8.0


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3, epochs: int = 3) -> FtrlModel:
    """FTRL-proximal over (label, feature numbers, values), in the given order; the last slot is the bias."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)

    def current(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for y, at, value in rows:
            at, x = np.append(at, SIZE), np.append(value * SCALE, 1.0)
            w = current(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    weights = current(np.arange(SIZE + 1)).astype(np.float32)
    return FtrlModel(weights[:-1], float(weights[-1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, quality) of at most `rows` labelled documents outside the held-out fold, those with the lowest hash
    of their id. Null labels are left out, of several labels of a document the largest counts."""
    doc_id = F.col("doc_id")
    chosen = (
        labels.where(doc_id.isNotNull() & F.col("quality").isNotNull() & (fold(doc_id) != 0))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # of a bounded number of rows


def _views(part: pa.Array, kind: type) -> list[np.ndarray]:
    """The numbers of each row of a binary array without nulls, not copied: the driver holds the features once."""
    part = part.cast(pa.large_binary())
    _, offsets, data = part.buffers()
    ends = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1].tolist()
    return [np.frombuffer(data, kind, (b - a) // np.dtype(kind).itemsize, a) if b > a else np.empty(0, kind) for a, b in pairwise(ends)]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FtrlModel:
    """Fits on a bounded sample; features are made by the executors. Without any label every score is 0.5."""

    def make():
        memo = new_memo()

        def work(texts: list, batch: pa.RecordBatch) -> dict:
            found = [features(t, memo) for t in texts]
            return {"doc_id": batch["doc_id"], "quality": batch["quality"], "at": [a.tobytes() for a, _ in found], "value": [v.tobytes() for _, v in found]}

        return work

    sample = labelled_sample(docs, labels, rows).select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text")
    got = map_texts(sample, make, "doc_id long, quality int, at binary, value binary").toArrow()
    view = lambda col, kind: (x for part in got[col].chunks for x in _views(part, kind))
    found = [(int(q > 0), a, v, zlib.crc32(b"%d" % d)) for d, q, a, v in zip(got["doc_id"].to_pylist(), got["quality"].to_pylist(), view("at", np.int32), view("value", np.float32), strict=True)]
    found.sort(key=lambda x: (x[3], len(x[1])))
    return ftrl([x[:3] for x in found]) if found else FtrlModel(np.zeros(SIZE, np.float32), 0.0)


def score_column(model: FtrlModel, text: Column, spark) -> Column:
    """The probability that a text's label is 1, as a column."""
    shared = spark.sparkContext.broadcast(model)  # of fixed size
    small_batches(spark)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        memo, mine = shared_memo(), shared.value
        return pd.Series([mine.score((t or "").encode(), memo) for t in texts], dtype="float64")

    return score(text)


def classify(docs: DataFrame, model: FtrlModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. A null or empty text gets the score of no words. Rows are
    scored alone, so repeated rows repeat their score and an empty table gives no rows; other columns aren't read."""
    spark, doc_id = docs.sparkSession, F.col("doc_id")
    shared = spark.sparkContext.broadcast(model)

    def make():
        memo = shared_memo()
        return lambda texts, batch: {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": [shared.value.score(t, memo) for t in texts]}

    scored = map_texts(docs.select(doc_id.cast("long").alias("doc_id"), (fold(doc_id) == 0).alias("held_out"), text_of().alias("text")), make, "doc_id long, held_out boolean, score double", keeps=True)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
