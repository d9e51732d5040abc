"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

log P(w | h) = log P(class(w) | h) + log P(code(w) | class(w), h) + log P(w | code(w)). The first two factors are log-linear over
features of the history, both trained; the third is a word's share of its code. Frequent words have a code of their own, all others
share TAIL_CODES hashed codes, so that the outcomes stay bounded however large the vocabulary is.

A history has three nested features: the word before (or, where that is a hashed one, the skip feature of the word before it), the
two words before, the three words before. Level by level, a feature gets a weight for each outcome that it has in training, on top
of the distribution of the level above. Given that, the features of one level are independent, and each one's weights maximise its
own concave likelihood with a Gaussian prior: damped Newton gradient updates from zero, over all its training tokens, until none
moves. So the weights don't depend on an order or a layout of the data.

Histories are dealt out by their first feature: blocks of documents send their distinct (history, word) events with their counts to
shards, which train the weights of their features and answer each event with its log probability. A feature of more than HOT_TOKENS
tokens is trained from its aggregated counts instead, in a table of bounded size, and its events are dealt out by the next feature.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, fold, forget_shuffles, small_batches, stored, text_of, token_runs

#: A token that no text has: words hold no space.
END = " "
#: Words that have a code of their own, a bound on what is broadcast; all others share hashed codes.
HEAD_WORDS, TAIL_CODES = 1 << 18, 1 << 20
#: Words that stand for contexts, and words that are grouped by them at first.
ANCHORS, GROUPED = 256, 4096
GROUPS = 8
#: Upper ends, by rank, of the frequency bands of a group; the last takes all other head words. Hashed codes are one more class.
BANDS = (128, 4096)
CLASSES = GROUPS * (len(BANDS) + 1) + 1
#: Bits of a code in a history's key: three codes plus one, 0 for none, the nearest first. The top bit marks a skip feature.
CODE_BITS = 21
LEVELS = 3
#: Variances of the prior of class and of word weights, and most updates.
CLASS_VARIANCE, WORD_VARIANCE, UPDATES = 2.0, 4.0, 30
#: Tokens of a block of documents and of a segment of a long one, of a shard, and those above which a feature is dealt out further.
BLOCK_TOKENS, SHARD_TOKENS, HOT_TOKENS = 1 << 20, 1 << 18, 1 << 19
BLOCKS = 16
#: Steps of a log probability that shards send back, for 1.
STEPS = 1 << 12


@dataclass
class Head:
    """Frequent words by falling count; tail: the counts of the hashed codes."""

    words: list[str]
    counts: np.ndarray
    tail: np.ndarray
    tokens: int
    distinct: int
    singles: int

    @property
    def total(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    @property
    def unknown(self) -> float:
        """The weight of an unknown word in each hashed code; all together weigh as the words seen once."""
        return (self.singles + 0.5) / TAIL_CODES

    def mass(self) -> np.ndarray:
        return np.concatenate([self.counts.astype(float), self.tail + self.unknown])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows of `docs` (text), one END a row included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def flush():
            words, n = list(count), list(count.values())
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.binary()).cast(pa.string()), pa.array(n[at : at + 50_000], pa.int64())], ["word", "n"])
            count.clear()

        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                for words in token_runs(text.as_buffer()):
                    count.update(words)
                    if len(count) > 400_000:
                        yield from flush()
                count[END.encode()] += 1
        yield from flush()

    small_batches(docs.sparkSession)
    return docs.select(text_of().alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, most: int = HEAD_WORDS) -> Head:
    """The words above the least power of 2**(1/8) that at most `most` words reach, those that occur once never."""
    step = F.floor(F.log2("n") * 8).cast("int")
    by_step = sorted(((r["s"], r["words"], r["tokens"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).collect()), reverse=True)  # at most 8 rows a doubling
    reached, least = 0, None
    for s, words, _ in by_step:
        if reached + words > most or s == 0:
            break
        reached, least = reached + words, s
    rows = counts.where(step >= least).toArrow() if least is not None else None  # at most `most` rows
    words, n = (rows["word"].to_pylist(), rows["n"].to_numpy()) if rows is not None else ([], np.empty(0, np.int64))
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rest = counts if least is None else counts.where(step < least)
    found = rest.groupBy((F.crc32("word") % TAIL_CODES).alias("code")).agg(F.sum("n").alias("n")).toArrow()  # at most TAIL_CODES rows
    tail = np.zeros(TAIL_CODES)
    tail[found["code"].to_numpy()] = found["n"].to_numpy()
    return Head([words[i] for i in order], n[order].astype(np.int64), tail, sum(t for *_, t in by_step), sum(w for _, w, _ in by_step), sum(w for s, w, _ in by_step if s == 0))


def packed(a: np.ndarray, rising: bool = False) -> bytes:
    """The array's bytes by place, compressed; of sorted keys the steps."""
    if rising:
        a = np.diff(a, prepend=a.dtype.type(0))
    return len(a).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str, rising: bool = False) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    a = np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()
    return np.cumsum(a, dtype=kind) if rising else a


#: The head words' numbers, one table for all tasks of a worker.
_NUMBERS: dict[str, dict[bytes, int]] = {}
_BLOCK = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("uid", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("fold", pa.list_(pa.int32())), ("size", pa.list_(pa.int64())), ("lead", pa.list_(pa.int32())), ("codes", pa.binary()),
                    ("of", pa.list_(pa.int64())), ("words", pa.list_(pa.string())), ("times", pa.list_(pa.int64())), ("weight", pa.list_(pa.float64()))])
_WORDS = ("of", "words", "times")
_BLOCK_TYPE = "kind string, block long, uid array<long>, doc_id array<long>, fold array<int>, size array<long>, lead array<int>, codes binary, of array<long>, words array<string>, times array<long>, weight array<double>"


def coded(docs: DataFrame, head: Head, block_tokens: int, run_bytes: int | None = None) -> DataFrame:
    """Blocks of about `block_tokens` tokens, a row of each kind. The kind "codes" has segments of documents: uid, doc_id, fold, size
    (tokens without the lead), lead (codes of the segment before that come first), weight (the sum of hashed codes' log10 weights),
    and the codes of all, packed. The kind "words" has the words without a code of their own of each document (of: its uid), and
    their times. END is the last token of every document."""
    spark, size, key = docs.sparkSession, len(head.words), uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((head.words, np.log10(head.tail + head.unknown).astype(np.float64)))  # bounded by HEAD_WORDS and TAIL_CODES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, weights = shared.value
        numbers, block, filled = _NUMBERS.get(key), TaskContext.get().partitionId() << 32, 0
        if numbers is None:
            _NUMBERS.clear()
            numbers = _NUMBERS[key] = {w.encode(): i for i, w in enumerate(words)}
        get, codes = numbers.get, []
        columns: dict[str, list] = {name: [] for name in _BLOCK.names if name not in ("kind", "block", "codes")}

        def flush():
            nonlocal block, filled
            row = {"kind": ["codes", "words"], "block": [block, block], "codes": [packed(np.concatenate(codes)), None]}
            row |= {k: [None, v] if k in _WORDS else [v, None] for k, v in columns.items()}
            yield pa.RecordBatch.from_pydict(row, schema=_BLOCK)
            codes.clear()
            for v in columns.values():
                v.clear()
            block, filled = block + 1, 0

        for batch in batches:
            for uid, doc_id, in_fold, text in zip(batch["uid"].to_pylist(), batch["doc_id"].to_pylist(), batch["fold"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                lead = np.empty(0, "<i4")
                for tokens in token_runs(text.as_buffer(), END.encode(), run_bytes):
                    own = np.fromiter(map(get, tokens, repeat(-1)), "<i4", len(tokens))
                    other = np.flatnonzero(own < 0)
                    rest = Counter(tokens[i] for i in other.tolist())
                    hashed = {w: zlib.crc32(w) % TAIL_CODES for w in rest}
                    own[other] = [size + hashed[tokens[i]] for i in other.tolist()]
                    columns["uid"].append(uid)
                    columns["doc_id"].append(doc_id)
                    columns["fold"].append(in_fold)
                    columns["size"].append(len(own))
                    columns["lead"].append(len(lead))
                    columns["of"] += repeat(uid, len(rest))
                    columns["words"] += [w.decode() for w in rest]
                    columns["times"] += rest.values()
                    columns["weight"].append(float(weights[list(hashed.values())] @ np.array(list(rest.values()), float)) if rest else 0.0)
                    codes += [lead, own]
                    lead = np.concatenate([lead, own[-LEVELS:]])[-LEVELS:]
                    filled += len(own)
                    if filled >= block_tokens:
                        yield from flush()
        if codes:
            yield from flush()

    small_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id")).cast("int").alias("fold"), text_of().alias("text"))
    return rows.mapInArrow(run, _BLOCK_TYPE)


class Block:
    """The tokens of a row of `coded`: codes with leads, and which of them count."""

    def __init__(self, row: dict, held_out_fold: int):
        self.codes = unpacked(row["codes"], "<i4").astype(np.int64)
        self.size, lead = np.array(row["size"], np.int64), np.array(row["lead"], np.int64)
        self.starts = np.cumsum(self.size + lead) - self.size - lead  # of segments, leads included
        self.own = np.ones(len(self.codes), bool)
        for s, n in zip(self.starts[lead > 0].tolist(), lead[lead > 0].tolist(), strict=True):
            self.own[s : s + n] = False
        self.training = np.repeat(np.array(row["fold"], np.int64) != held_out_fold, self.size + lead) & self.own

    def before(self, back: int) -> np.ndarray:
        """The code `back` tokens before each plus one, 0 where the document has none."""
        out = np.concatenate([np.zeros(back, np.int64), self.codes + 1])[: len(self.codes)]
        for i in range(back):
            at = self.starts + i
            out[at[at < np.append(self.starts[1:], len(out))]] = 0
        return out

    def keys(self, head: int) -> np.ndarray:
        """The history of each token: three codes in 64 bits, so that a level's feature is a prefix. Where the word before has a
        hashed code, the word before that comes first, and the top bit is set."""
        p1, p2 = self.before(1), self.before(2)
        skips, bits = p1 > head, np.uint64(CODE_BITS)
        keys = skips.astype(np.uint64)
        for code in (np.where(skips, p2, p1), np.where(skips, p1, p2), self.before(3)):
            keys <<= bits
            keys |= code.astype(np.uint64)
        return keys


def blocks_of(rows: DataFrame, *more: str) -> DataFrame:
    small_batches(rows.sparkSession)
    return rows.where("kind = 'codes'").select("block", "size", "lead", "fold", "codes", *more)


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def summed(df: DataFrame, add: Callable[[dict, np.ndarray], None], shape: tuple[int, ...], kind: str) -> np.ndarray:
    """The sum over all tasks of an array of a fixed shape: `add` adds a row to an array.

    Tasks send their arrays in blocks, which are added 64 at a time; the driver gets one array.
    """
    size = int(np.prod(shape))
    edges = np.linspace(0, size, BLOCKS + 1).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, any_rows = np.zeros(size, kind), False
        for row in each_row(batches):
            any_rows = True
            add(row, total)
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * BLOCKS, pa.int64()), pa.array(range(BLOCKS), pa.int32()), pa.array([packed(total[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], ["part", "block", "data"])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = unpacked(pdf["data"][0], kind)
        for x in pdf["data"][1:]:
            total = total + unpacked(x, kind)
        return pd.DataFrame({"part": [int(key[0])], "block": [int(key[1])], "data": [packed(total)]})

    parts, rows = max(1, df.rdd.getNumPartitions()), df.mapInArrow(run, "part long, block int, data binary")
    while True:
        parts = -(-parts // 64)
        rows = rows.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("part", "block").applyInPandas(merge, "part long, block int, data binary")
        if parts == 1:
            break
    got = {r["block"]: unpacked(r["data"], kind) for r in rows.collect()}  # BLOCKS rows
    return np.concatenate([got.get(b, np.zeros(edges[b + 1] - edges[b], kind)) for b in range(BLOCKS)]).reshape(shape)


def group_words(context: np.ndarray, groups: int = GROUPS, rounds: int = 25) -> np.ndarray:
    """Spherical k-means of words by the anchors before them; deterministic: centres start far apart."""
    x = np.sqrt(context.astype(float))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    weight = context.sum(1).astype(float)
    centres = [x[weight.argmax()]]
    for _ in range(groups - 1):
        far = (1 - np.max(x @ np.array(centres).T, axis=1)) * np.log1p(weight)
        centres.append(x[far.argmax()])
    centre = np.array(centres)
    for _ in range(rounds):
        group = (x @ centre.T).argmax(1)
        for g in range(groups):
            mean = x[group == g].sum(0)
            if np.linalg.norm(mean) > 0:
                centre[g] = mean / np.linalg.norm(mean)
    return (x @ centre.T).argmax(1)


def word_classes(rows: DataFrame, head: Head, held_out_fold: int) -> np.ndarray:
    """The class of each code. Head words are grouped by the frequent words that they follow in training, then by frequency."""
    size = len(head.words)
    grouped = min(GROUPED, size)
    if not grouped:
        return np.full(TAIL_CODES, CLASSES - 1)

    def contexts(row: dict, total: np.ndarray) -> None:
        block = Block(row, held_out_fold)
        prev = block.before(1) - 1
        ok = block.training & (prev >= 0) & (prev < ANCHORS) & (block.codes < grouped)
        total += np.bincount(block.codes[ok] * ANCHORS + prev[ok], minlength=len(total)).astype(total.dtype)

    group = group_words(summed(blocks_of(rows), contexts, (grouped, ANCHORS), "<i8"))
    known = np.concatenate([group, np.full(size - grouped, -1)])

    def followers(row: dict, total: np.ndarray) -> None:
        block = Block(row, held_out_fold)
        for back in (1, 2):
            prev = block.before(back) - 1
            ok = block.training & (prev >= 0) & (prev < grouped) & (block.codes >= grouped) & (block.codes < size)
            np.add.at(total, (block.codes[ok] - grouped) * GROUPS + known[prev[ok]], 1)

    if size > grouped:
        seen = summed(blocks_of(rows), followers, (size - grouped, GROUPS), "<i4").astype(float)
        share = np.bincount(group, head.counts[:grouped], GROUPS) + 1
        known[grouped:] = (seen / share * share.sum()).argmax(1)
    classes = known * (len(BANDS) + 1) + np.searchsorted(BANDS, np.arange(size), "right")
    return np.concatenate([classes, np.full(TAIL_CODES, CLASSES - 1)])


def order_of(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Places in the order of (high, low), both non-negative. Where both and the place fit into 64 bits, values are sorted, which
    takes a fraction of the time of sorting places."""
    if not len(high):
        return np.empty(0, np.int64)
    low_bits, at_bits = max(1, int(low.max()).bit_length()), max(1, len(high).bit_length())
    if int(high.max()).bit_length() + low_bits + at_bits > 63:
        return np.lexsort((low, high))
    value = ((high.astype(np.int64) << low_bits) + low << at_bits) + np.arange(len(high))
    value.sort()
    return value & ((1 << at_bits) - 1)


def firsts(*sorted_arrays: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    new = np.zeros(len(sorted_arrays[0]), bool)
    new[:1] = True
    for a in sorted_arrays:
        new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def by_key(keys: np.ndarray, outcomes: np.ndarray) -> np.ndarray:
    """Places in the order of (key of 64 bits, outcome)."""
    order = np.argsort(keys)
    first = firsts(keys[order])
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return order_of(rank, outcomes)


def trained_alone(n: np.ndarray, q: np.ndarray, variance: float, updates: int) -> np.ndarray:
    """The weights of cells that are the only ones of their features, by the updates of `trained`."""
    weight, on = np.zeros(len(n)), np.arange(len(n))
    while len(on) and updates:
        updates -= 1
        mine, w, own = n[on], weight[on], q[on]
        e = own * np.exp(w)
        z = 1 + e - own
        p, others = e / z, (1 - own) / z
        step = (mine * others - w / variance) / (mine * p * others + 1 / variance)
        weight[on] = w + np.clip(step, -2, 2)
        on = on[np.abs(step) > 1e-7]
    return weight


def trained(first: np.ndarray, n: np.ndarray, q: np.ndarray, variance: float, updates: int = UPDATES) -> np.ndarray:
    """The log probabilities of outcomes under features whose weights are trained, in the order of the cells.

    A cell is a feature and an outcome; `first` has the place of each feature's first cell, n the training tokens of each cell, q the
    outcomes' probabilities without the feature. Cells with n = 0 have no weight. p = q exp(weight) / Z, with Z the sum over all
    outcomes, of which those that aren't cells add their q. Each update is a Newton step of the gradient n - N p - weight /
    variance, damped to a step of 2; features that don't move any more leave.
    """
    size = np.diff(np.append(first, len(n)))
    weight = np.zeros(len(n))
    feature = np.repeat(np.arange(len(first)), size)
    cells = np.flatnonzero(n > 0)
    single = np.bincount(feature[cells], minlength=len(first))[feature[cells]] == 1  # most features have one cell
    weight[cells[single]] = trained_alone(n[cells[single]], q[cells[single]], variance, updates)
    cells = cells[~single]
    at = firsts(feature[cells]) if len(cells) else np.empty(0, np.int64)
    while len(cells) and updates:
        updates -= 1
        sizes = np.diff(np.append(at, len(cells)))
        spread = lambda x, sizes=sizes: np.repeat(x, sizes)
        total = lambda x, at=at: np.add.reduceat(x, at)
        mine, w, own = n[cells], weight[cells], q[cells]
        e = own * np.exp(w)
        tokens = total(mine)
        p = e / spread(1 + total(e - own))
        curve = 1 / (spread(tokens) * p + 1 / variance)
        a, b = (mine - spread(tokens) * p - w / variance) * curve, p * curve
        step = a + b * spread(tokens * total(p * a) / np.maximum(1 - tokens * total(p * b), 1e-12))  # the Hessian's inverse by the matrix lemma
        weight[cells] = w + np.clip(step, -2, 2)
        moves = np.maximum.reduceat(np.abs(step), at) > 1e-7
        if not moves.all():
            cells = cells[spread(moves)]
            at = np.cumsum(sizes[moves]) - sizes[moves]
    e = q * np.exp(weight)
    z = 1 + np.add.reduceat(e - q, first) if len(first) else np.empty(0)
    return np.log(q) + weight - np.repeat(np.log(z), size)


def level(feature: np.ndarray, outcome: np.ndarray, n: np.ndarray, log_class: np.ndarray, log_word: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of events (feature, outcome), of the outcome's class and of it within the class, with the level's weights;
    given: those of the level above. `feature` has small numbers; outcomes are numbered by class, `classes` has the class of each."""
    order = order_of(feature, outcome)
    f, o = feature[order], outcome[order]
    cell = firsts(f, o)
    n_cell = np.add.reduceat(n[order], cell) if len(cell) else n
    f, c, at = f[cell], classes[o[cell]], order[cell]
    group = firsts(f, c)  # the class's cells of a feature
    in_group = np.diff(np.append(group, len(cell)))
    word = trained(group, n_cell, np.exp(log_word[at]), WORD_VARIANCE)
    own = trained(firsts(f[group]), np.add.reduceat(n_cell, group) if len(group) else n_cell, np.exp(log_class[at[group]]), CLASS_VARIANCE)
    back = np.empty(len(order), np.int64)
    back[order] = np.repeat(np.arange(len(cell)), np.diff(np.append(cell, len(order))))
    return np.repeat(own, in_group)[back], word[back]


def prefixes(keys: np.ndarray, depth: int) -> np.ndarray:
    """The features of histories at a level from 1 to LEVELS."""
    return keys >> np.uint64(CODE_BITS * (LEVELS - depth))


def train_and_score(keys: np.ndarray, outcome: np.ndarray, n: np.ndarray, log_class: np.ndarray, log_word: np.ndarray, classes: np.ndarray, above: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of distinct events, sorted by key and outcome, whose levels up to `above` are done."""
    for depth in range(above + 1, LEVELS + 1):
        own = prefixes(keys, depth)
        first = firsts(own)
        feature = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(own))))
        log_class, log_word = level(feature, outcome, n, log_class, log_word, classes)
    return log_class, log_word


@dataclass
class Outcomes:
    """Codes in the order of their class: the place of each code; by place the class and, without a history, the log share in the
    class; and the log shares of classes."""

    place: np.ndarray
    classes: np.ndarray
    log_class: np.ndarray
    log_word: np.ndarray

    @classmethod
    def of(cls, mass: np.ndarray, classes: np.ndarray) -> Outcomes:
        order = np.argsort(classes, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        by_class = np.bincount(classes, mass, CLASSES)
        own = classes[order]
        with np.errstate(divide="ignore"):  # classes without codes
            return cls(place, own.astype(np.int8), np.log(by_class / mass.sum()), np.log(mass[order] / by_class[own]))


@dataclass
class Hot:
    """Features with more tokens than a shard should have, by level and then key: parent (-1: none), and first shard of those that
    its events are dealt out to."""

    depth: np.ndarray
    key: np.ndarray
    parent: np.ndarray
    shard: np.ndarray
    shards: np.ndarray

    def deepest(self, keys: np.ndarray) -> np.ndarray:
        """For each history the number of its deepest hot feature, -1 for none. A feature within a hot one only can be hot."""
        out = np.full(len(keys), -1)
        for depth in range(1, LEVELS + 1):
            mine = np.flatnonzero(self.depth == depth)
            if len(mine):
                own = prefixes(keys, depth)
                at = np.minimum(np.searchsorted(self.key[mine], own), len(mine) - 1)
                out = np.where(self.key[mine][at] == own, mine[at], out)
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shard_of(keys: np.ndarray, outcome: np.ndarray, hot: Hot, shards: int) -> np.ndarray:
    out = (mixed(prefixes(keys, 1)) % np.uint64(shards)).astype(np.int64)
    deepest = hot.deepest(keys)
    for depth in range(1, LEVELS + 1):
        mine = np.flatnonzero(deepest >= 0)
        mine = mine[hot.depth[deepest[mine]] == depth] if len(mine) else mine
        if len(mine):
            own, node = prefixes(keys[mine], depth + 1) if depth < LEVELS else outcome[mine].astype(np.uint64), deepest[mine]
            out[mine] = hot.shard[node] + (mixed(own) % hot.shards[node].astype(np.uint64)).astype(np.int64)
    return out


def find_hot(rows: DataFrame, head: int, tokens: int, hot_tokens: int, shards: int) -> Hot:
    """Of each block, features with at least a quarter of the share that makes them hot are counted, which finds at least three
    quarters of a hot feature's tokens. At most 8 * LEVELS * tokens / hot_tokens features are found, about one a shard."""
    found: list[tuple[int, int, int]] = []
    if tokens > hot_tokens:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in each_row(batches):
                block = Block(row, -1)
                keys = np.sort(block.keys(head)[block.own])
                for depth in range(1, LEVELS + 1):
                    own = prefixes(keys, depth)
                    first = firsts(own)
                    n = np.diff(np.append(first, len(own)))
                    many = n >= hot_tokens * len(keys) / tokens / 4
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(many.sum(), depth), pa.int32()), pa.array(own[first[many]].view(np.int64), pa.int64()), pa.array(n[many], pa.int64())], ["depth", "key", "n"])

        counts = blocks_of(rows).mapInArrow(run, "depth int, key long, n long").groupBy("depth", "key").agg(F.sum("n").alias("n"))
        found = [(r["depth"], r["key"] % (1 << 64), r["n"]) for r in counts.where(F.col("n") > hot_tokens * 3 // 4).collect()]
    found.sort()
    number = {(d, k): i for i, (d, k, _) in enumerate(found)}
    parent = [number.get((d - 1, k >> CODE_BITS), -1) for d, k, _ in found]
    many = np.array([-(-n * 2 // hot_tokens) for *_, n in found], np.int64)
    return Hot(np.array([d for d, *_ in found], np.int64), np.array([k for _, k, _ in found], np.uint64), np.array(parent, np.int64), shards + np.cumsum(many) - many, many)


def events_of(block: Block, head: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, outcomes and training counts of a block's distinct events, in order, and the event of each of its own tokens."""
    keys, outcome, training = block.keys(head)[block.own], place[block.codes[block.own]].astype(np.int64), block.training[block.own]
    order = by_key(keys, outcome)
    first = firsts(keys[order], outcome[order])
    back = np.empty(len(order), np.int64)
    back[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    at = order[first]
    return keys[at], outcome[at], np.bincount(back, training, len(at)).astype(np.int64), back


def dealt(keys: np.ndarray, outcome: np.ndarray, hot: Hot, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards and order of a block's events by shard."""
    shard = shard_of(keys, outcome, hot, shards)
    return shard, order_of(shard, np.arange(len(shard)))


def hot_tables(rows: DataFrame, head: int, shared, hot: Hot, held_out_fold: int) -> DataFrame:
    """(node, outcome, log_class, log_word) of each hot feature, packed: its events' log probabilities. Blocks count a feature's
    outcomes, of bounded number, and their counts are summed 64 at a time."""
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outcomes = shared.value
        for row in each_row(batches):
            block = Block(row, held_out_fold)
            keys, outcome, n, _ = events_of(block, head, outcomes.place)
            node = hot.deepest(keys)
            while (on := node >= 0).any():
                keys, outcome, n, node = keys[on], outcome[on], n[on], node[on]
                order = order_of(node, outcome)
                first = firsts(node[order], outcome[order])
                yield counted(node[order][first], outcome[order][first], np.add.reduceat(n[order], first), row["block"])
                node = hot.parent[node]

    def counted(node: np.ndarray, outcome: np.ndarray, n: np.ndarray, part: int) -> pa.RecordBatch:
        """A row for each feature: its outcomes, sorted, and their counts, packed."""
        first = firsts(node)
        parts = [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(node)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(hot.depth[node[first]], pa.int32()), pa.array(node[first], pa.int64()), pa.array([part] * len(parts), pa.int64()), pa.array([packed(outcome[x], True) for x in parts], pa.binary()), pa.array([packed(n[x]) for x in parts], pa.binary())], names)

    def merge(key: tuple, found: pa.Table) -> pa.Table:
        outcome, n = (np.concatenate([unpacked(x.as_py(), "<i8", c == "outcome") for x in found[c]]) for c in ("outcome", "n"))
        order = np.argsort(outcome, kind="stable")
        first = firsts(outcome[order])
        return pa.Table.from_batches([counted(np.full(len(first), key[0].as_py()), outcome[order][first], np.add.reduceat(n[order], first), key[1].as_py())])

    forget_shuffles(spark)
    names, kind = ["depth", "node", "part", "outcome", "n"], "depth int, node long, part long, outcome binary, n binary"
    blocks = blocks_of(rows)
    counts, parts = blocks.mapInArrow(run, kind), max(1, blocks.count()) if len(hot.key) else 1
    while True:  # 64 blocks at a time
        parts = -(-parts // 64)
        counts = counts.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(parts))).groupBy("node", "part").applyInArrow(merge, kind)
        if parts == 1:
            break
    counts = stored(counts, "hot", by="depth")
    kinds = "node long, outcome binary, log_class binary, log_word binary"

    def train(key: tuple, own: pa.Table, above: pa.Table) -> pa.Table:
        outcome, n, tables = unpacked(own["outcome"][0].as_py(), "<i8", True), unpacked(own["n"][0].as_py(), "<i8"), shared.value
        if above.num_rows:
            at = np.searchsorted(unpacked(above["outcome"][0].as_py(), "<i8", True), outcome)
            log_class, log_word = (unpacked(above[c][0].as_py(), "<f8")[at] for c in ("log_class", "log_word"))
        else:
            log_class, log_word = tables.log_class[tables.classes[outcome]], tables.log_word[outcome]
        log_class, log_word = level(np.zeros(len(n), np.int64), outcome, n.astype(float), log_class, log_word, tables.classes)
        return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "outcome": [packed(outcome.astype("<i8"), True)], "log_class": [packed(log_class)], "log_word": [packed(log_word)]})

    forget_shuffles(spark)
    done = spark.createDataFrame([], kinds)
    for depth in range(1, LEVELS + 1):
        mine = np.flatnonzero(hot.depth == depth)
        if len(mine):
            links = spark.createDataFrame(pd.DataFrame({"child": mine, "node": hot.parent[mine]}))
            above = done.join(links, "node").drop("node").withColumnRenamed("child", "node")
            done = done.unionByName(stored(counts.where(F.col("depth") == depth).groupBy("node").cogroup(above.groupBy("node")).applyInArrow(train, kinds), "hot"))
    return done


def event_scores(rows: DataFrame, head: int, shared, hot: Hot, shards: int, held_out_fold: int) -> DataFrame:
    """(block, shard, scores): the log probabilities of each block's events in the order of `dealt`, rounded to a step."""
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            keys, outcome, n, _ = events_of(Block(row, held_out_fold), head, shared.value.place)
            shard, order = dealt(keys, outcome, hot, shards)
            first = firsts(shard[order])
            parts = [order[a:b] for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[order][first], pa.int64()), pa.array([row["block"]] * len(parts), pa.int64()), pa.array([packed(keys[x], True) for x in parts], pa.binary()), pa.array([packed(outcome[x].astype("<u4")) for x in parts], pa.binary()), pa.array([packed(n[x].astype("<u4")) for x in parts], pa.binary())],
                ["shard", "block", "keys", "outcome", "n"])

    def work(key: tuple, sent: pa.Table, given: pa.Table) -> pa.Table:
        if not sent.num_rows:  # a hot feature's shard that no event fell to
            return pa.table({"block": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "scores": pa.array([], pa.binary())})
        tables = shared.value
        columns = [[unpacked(x.as_py(), kind, c == "keys") for x in sent[c]] for c, kind in (("keys", "<u8"), ("outcome", "<u4"), ("n", "<u4"))]
        keys, outcome, n = (np.concatenate(c) for c in columns)
        outcome = outcome.astype(np.int64)
        order = by_key(keys, outcome)
        first = firsts(keys[order], outcome[order])
        at, n = order[first], np.add.reduceat(n[order].astype(float), first)
        back = np.empty(len(order), np.int64)
        back[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        keys, outcome, above = keys[at], outcome[at], 0
        if given.num_rows:
            node = given["node"][0].as_py()
            place = np.searchsorted(unpacked(given["outcome"][0].as_py(), "<i8", True), outcome)
            log_class, log_word = (unpacked(given[c][0].as_py(), "<f8")[place] for c in ("log_class", "log_word"))
            above = int(hot.depth[node])
        else:
            log_class, log_word = tables.log_class[tables.classes[outcome]], tables.log_word[outcome]
        scores = np.rint(-STEPS * np.add(*train_and_score(keys, outcome, n, log_class, log_word, tables.classes, above))).astype("<u4")[back]
        ends = np.cumsum([len(x) for x in columns[0]])
        return pa.table({"block": sent["block"], "shard": pa.array([key[0].as_py()] * sent.num_rows, pa.int64()), "scores": pa.array([packed(x) for x in np.split(scores, ends[:-1])], pa.binary())})

    sent = blocks_of(rows).mapInArrow(run, "shard long, block long, keys binary, outcome binary, n binary")
    tables = hot_tables(rows, head, shared, hot, held_out_fold)
    spans = spark.createDataFrame(pd.DataFrame({"node": np.arange(len(hot.key)), "a": hot.shard, "b": hot.shard + hot.shards - 1}), "node long, a long, b long")
    given = tables.join(spans, "node").withColumn("shard", F.explode(F.sequence("a", "b"))).drop("a", "b")
    return sent.groupBy("shard").cogroup(given.groupBy("shard")).applyInArrow(work, "block long, shard long, scores binary")


def score_documents(docs: DataFrame, held_out_fold: int = 1, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, hot_tokens: int = HOT_TOKENS, run_bytes: int | None = None) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Learns from the rows whose fold isn't `held_out_fold`, scores all. A null or empty text is one END; a null id has the fold of
    the empty text. Repeated rows are counted and scored each; without training rows all words are unknown, and the hashed codes
    are equally likely. Words without training share a hashed code's weight of the unknown, so the probabilities of all known words
    and of one unknown word a hashed code sum to one. Long texts are cut into segments that keep the words before them. An empty
    table gives no rows. Columns other than doc_id and text aren't read. The sizes at the end change no score.
    """
    spark = docs.sparkSession
    counts = stored(word_counts(docs.where(fold(F.col("doc_id")) != held_out_fold)), "counts")
    head = head_of(counts)
    size = len(head.words)
    rows = stored(coded(docs, head, block_tokens, run_bytes), "codes", by="kind")
    # words without a code of their own: their counts give base scores, and their shares of their codes
    rest = rows.where("kind = 'words'").select(F.explode(F.arrays_zip("of", "words", "times")).alias("e")).select(F.col("e.of").alias("uid"), F.col("e.words").alias("word"), F.col("e.times").alias("times"))
    n, nothing = F.coalesce("n", F.lit(0)), lambda kind: F.lit(None).cast(kind)
    rest = rest.join(counts, "word", "left").groupBy("uid").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("times") * F.log10((n + 0.5) / F.lit(head.total))).alias("base_score"),
        F.sum(F.col("times") * F.log10(F.when(n > 0, n.cast("double")).otherwise(F.lit(head.unknown)))).alias("score"),
    )
    rest = stored(rest.select("uid", nothing("long").alias("doc_id"), nothing("int").alias("fold"), F.lit(0).cast("long").alias("n_tokens"), "n_known", "base_score", "score"), "rest")
    drop_stored(spark, counts)
    drop_stored(spark, rows, only="kind=words/")
    shared = spark.sparkContext.broadcast(Outcomes.of(head.mass(), word_classes(rows, head, held_out_fold)))  # bounded by HEAD_WORDS and TAIL_CODES
    tokens = blocks_of(rows).agg(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    shards = max(1, -(-tokens // shard_tokens))
    hot = find_hot(rows, size, tokens, hot_tokens, shards)
    scores = event_scores(rows, size, shared, hot, shards, held_out_fold)
    base = spark.sparkContext.broadcast(np.log10((head.counts + 0.5) / head.total))
    kinds = "uid long, doc_id long, fold int, n_tokens long, n_known long, base_score double, score double"

    def score(_: tuple, mine: pa.Table, answers: pa.Table) -> pa.Table:
        row = mine.to_pylist()[0]
        block = Block(row, held_out_fold)
        keys, outcome, _, back = events_of(block, size, shared.value.place)
        _, order = dealt(keys, outcome, hot, shards)
        found = np.empty(len(keys))
        answers = answers.sort_by("shard")
        found[order] = np.concatenate([unpacked(x.as_py(), "<u4") for x in answers["scores"]])
        codes, plain = block.codes[block.own], np.append(base.value, 0.0)
        at = np.cumsum(block.size) - block.size
        add = lambda x: pa.array(np.add.reduceat(x, at))
        return pa.table({"uid": pa.array(row["uid"], pa.int64()), "doc_id": pa.array(row["doc_id"], pa.int64()), "fold": pa.array(row["fold"], pa.int32()), "n_tokens": pa.array(row["size"], pa.int64()),
                         "n_known": add((codes < size).astype(np.int64)), "base_score": add(plain[np.minimum(codes, size)]), "score": pa.array(np.add.reduceat(found[back], at) / -(STEPS * np.log(10)) - np.array(row["weight"]))})

    blocks = blocks_of(rows, "uid", "doc_id", "weight")
    scored = blocks.groupBy("block").cogroup(scores.groupBy("block")).applyInArrow(score, kinds)
    whole = scored.unionByName(rest).groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("fold").alias("fold"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", (F.col("fold") == held_out_fold).alias("held_out"), "n_tokens", "n_known", F.lit(head.tokens).cast("long").alias("train_tokens"), "base_score", "score")
