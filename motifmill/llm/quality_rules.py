"""Quality rules: base thresholds, then gradient-boosted trees over document statistics.

The trees are grown on histograms of a bounded sample of labelled documents, with monotonic constraints on chosen
statistics, and flattened into numpy node arrays, so that a batch of documents descends all trees at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RUN_BYTES, forget_kept, map_texts, small_batches, text_of, text_runs
from .quality_classifier import labelled_sample

#: Most labelled rows that training takes, those of the lowest hash of their id.
TRAIN_ROWS = 12_000
THRESHOLD = 0.3
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(set(range(256)) - set(_SYMBOLS))
_NOT_UPPER = bytes(set(range(256)) - set(range(65, 91)))
_NOT_LOWER = bytes(set(range(256)) - set(range(97, 123)))
_NOT_DIGITS = bytes(set(range(256)) - set(range(48, 58)))
_NOT_MARKS = bytes(set(range(256)) - set(b"!?"))
_CONTINUED = bytes(range(0x80, 0xC0))
#: The statistics in the order of a feature row, with the sign that the score must follow (0: free).
STATISTICS = {"log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "upper_share": -1, "digit_share": 0, "mark_share": -1, "lines_per_word": 0, "top_word_share": -1}


def repeated_words(words: list, size: int = 5) -> int:
    """Words in windows of `size` words that occur twice or more in the list, first occurrences included."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count, end, covered = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + size - max(end, i)
            end = i + size
    return covered


def statistics(text: bytes) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the feature row of a text."""
    if len(text) > RUN_BYTES:
        return _long_statistics(text)
    words = text.split()
    n, glued = len(words), b"".join(words)
    chars = len(glued.translate(None, _CONTINUED))
    symbols = len(text.translate(None, _NOT_SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    count = Counter(words)
    return _row(n, chars, symbols, dup, repeat, len(lines), len(count), max(count.values(), default=0), *(len(glued.translate(None, x)) for x in (_NOT_UPPER, _NOT_LOWER, _NOT_DIGITS, _NOT_MARKS)), len(glued))


def _row(n: int, chars: int, symbols: int, dup: int, repeat: int, lines: int, distinct: int, top: int, upper: int, lower: int, digits: int, marks: int, size: int) -> tuple[tuple[int, int, int, int, int], list[float]]:
    m = max(n, 1)
    return (n, chars, symbols, dup, repeat), [
        np.log1p(n), chars / m, symbols / m, dup / max(lines, 1), repeat / m, distinct / m, upper / max(upper + lower, 1),
        digits / max(size, 1), marks / m, lines / m, top / m,
    ]


def _long_statistics(text: bytes) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """The same for a long text in runs: words are told apart by hashes of 64 bits, so that memory holds some 50 bytes a word."""
    hashes, totals = [], np.zeros(7, np.int64)
    for run in text_runs(text):
        words = run.split()
        glued = b"".join(words)
        totals += [len(glued.translate(None, x)) for x in (_CONTINUED, _NOT_SYMBOLS, _NOT_UPPER, _NOT_LOWER, _NOT_DIGITS, _NOT_MARKS)] + [len(glued)]
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
    word = np.concatenate(hashes)
    del hashes
    lines, dup, seen, at = 0, 0, set(), 0
    while at <= len(text):
        end = text.find(b"\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        at = end + 1
        if line.split(None, 1):
            lines += 1
            mark = xxhash.xxh128_digest(line)
            dup += mark in seen
            seen.add(mark)
    ordered = np.sort(word)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(word) else np.empty(0, np.int64)
    distinct, top = len(first), int(np.diff(np.append(first, len(word))).max(initial=0))
    del ordered, first
    window = word[: max(len(word) - 4, 0)].copy()
    for k in range(1, 5):
        window *= np.uint64(0x9E3779B97F4A7C15)
        window ^= window >> np.uint64(29)
        window += word[k : len(word) - 4 + k]
    ordered = np.sort(window)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    twice = twice[np.append(True, twice[1:] != twice[:-1])] if len(twice) else twice
    del ordered
    covered = np.zeros(len(word), bool)
    for at in range(0, len(window) if len(twice) else 0, 1 << 20):
        some = window[at : at + (1 << 20)]
        found = twice[np.minimum(np.searchsorted(twice, some), len(twice) - 1)] == some
        for k in range(5):
            covered[at + k : at + k + len(some)] |= found
    chars, symbols, upper, lower, digits, marks, size = totals.tolist()
    return _row(len(word), chars, symbols, dup, int(covered.sum()), lines, distinct, top, upper, lower, digits, marks, size)


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(1))))


def boost(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 64, least: float = 4.0, l2: float = 1.0) -> Trees:
    """Gradient boosting for the log loss. A split on a statistic with a sign is taken only if its two values follow that
    sign, and all leaves below stay on their side of the values' mean, so the whole sum is monotonic."""
    nodes: list[list] = []
    roots = []
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for col in x.T]
    codes = np.stack([np.searchsorted(e, col, "left") for e, col in zip(edges, x.T, strict=True)], 1)
    margin = np.full(len(y), bias)

    def value(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-rate * g / (h + l2), low, high))

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        at, g, h = len(nodes), grad[rows].sum(), hess[rows].sum()
        nodes.append([0, np.inf, at, at, value(g, h, low, high)])
        best = (1e-6, None)
        for f in range(x.shape[1]) if level < depth and len(edges) else ():
            size = len(edges[f]) + 1
            gl = np.cumsum(np.bincount(codes[rows, f], grad[rows], size))[:-1]
            hl = np.cumsum(np.bincount(codes[rows, f], hess[rows], size))[:-1]
            gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
            ok = (hl >= least / 4) & (h - hl >= least / 4)
            if signs[f]:
                vl, vr = np.clip(-rate * gl / (hl + l2), low, high), np.clip(-rate * (g - gl) / (h - hl + l2), low, high)
                ok &= (vr - vl) * signs[f] >= 0
            if ok.any() and (top := np.where(ok, gain, -np.inf)).max() > best[0]:
                best = (top.max(), (f, int(top.argmax())))
        if best[1]:
            f, b = best[1]
            goes = codes[rows, f] <= b
            parts = [rows[goes], rows[~goes]]
            bounds = [(low, high), (low, high)]
            if signs[f]:
                mid = sum(value(grad[p].sum(), hess[p].sum(), low, high) for p in parts) / 2
                bounds = [(low, mid), (mid, high)] if signs[f] > 0 else [(mid, high), (low, mid)]
            nodes[at][:2] = f, float(edges[f][b])
            nodes[at][2:4] = [grow(p, level + 1, *bound) for p, bound in zip(parts, bounds, strict=True)]
        else:
            margin[rows] += nodes[at][4]
        return at

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    feature, threshold, left, right, values = map(np.array, zip(*nodes, strict=True))
    return Trees(np.array(roots), feature, threshold, left, right, values, bias, depth)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Fits on the statistics of a bounded sample. Without labels of both kinds the trees keep every document."""
    make = lambda: lambda texts, batch: {"doc_id": batch["doc_id"], "quality": batch["quality"], "x": [statistics(t)[1] for t in texts]}
    got = map_texts(labelled_sample(docs, labels, rows).select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text"), make, "doc_id long, quality int, x array<double>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["quality"] > 0 for r in got], float)
    if not 0 < y.sum() < len(y):
        none = np.zeros(1, int)
        return Trees(none, none, np.array([np.inf]), none, none, np.zeros(1), 35.0, 1)
    return boost(np.array([r["x"] for r in got]), y, list(STATISTICS.values()))


def apply_rules(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, the five counts, base_failed, kept, score.

    A null or empty text has no words and so fails the base rules. Documents are judged alone: repeated rows repeat their
    verdict, an empty table gives none, and other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def make():
        def work(texts: list, batch: pa.RecordBatch) -> dict:
            found = [statistics(t) for t in texts]
            return {"doc_id": batch["doc_id"], **{n: [c[i] for c, _ in found] for i, n in enumerate(names)}, "score": shared.value.score(np.array([x for _, x in found]).reshape(len(found), len(STATISTICS)))}

        return work

    scored = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), make, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", score double")
    failed = base_failed()
    return scored.select("doc_id", *names, failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def kept_column(trees: Trees, text: Column, spark, threshold: float = THRESHOLD) -> Column:
    """Whether the rules keep a text, as a column."""
    shared = spark.sparkContext.broadcast(trees)
    small_batches(spark)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        forget_kept()
        found = [statistics((t or "").encode()) for t in texts]
        score = shared.value.score(np.array([x for _, x in found]).reshape(len(found), len(STATISTICS)))
        return pd.Series([c[0] >= 10 and 100 * c[4] <= 20 * c[0] and s >= threshold for (c, _), s in zip(found, score, strict=True)], dtype="bool")

    return kept(text)
