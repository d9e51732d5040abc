"""Packing token sequences by non-negative least squares over a histogram of lengths.

Documents are tokenised once. Whole windows are cut off a document's front; what rests is shorter than a window. All shallow
combinations of two or three rest lengths that fill a window exactly are enumerated, and non-negative least squares finds how
often to repeat each so that together they use up the histogram of rests. The counts are rounded within what there is, and the
rests that remain are packed greedily: one after another into the open sequence, cut where it is full. So only the very last
sequence is padded. The histogram and the plan have a size bounded by the window, whatever the number of documents.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RUN_BYTES, Memo, kept, map_texts, stored, text_of, text_runs

WINDOW = 2048
END_ID = 1
_MARK = "|"
#: The splitting for which letters and marks are encoded apart.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTING = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_MARKS = string.punctuation.encode()
#: Lower-case letters of ASCII and Latin-1, as UTF-8: they compose with nothing and have no other form.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: How a byte-level model spells the letters of Latin-1 in the letters of their bytes, the second of which begin at U+0122 up to 0xA0.
_BYTE_LETTERS = {c: "\xc3" + (chr(b) if (b := c - 0x40) > 0xA0 and b != 0xAD else chr(b + 0xA2) if b <= 0xA0 else "\u0143") for c in range(0xDF, 0x100)}
#: Words of a worker's memo, and as many old ones.
TOKEN_MEMO = 500_000


class WordTokenizer:
    """Ids of a tokenizer whose words, split at ASCII white space, are encoded independently; words are memoised.

    New words of a batch are encoded together, set apart by a mark that is a token of its own; words that hold the mark are
    encoded alone. A tokenizer for which white space matters gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tok, self.memo, self.old = Tokenizer.from_file(path), {}, {}
        mark = self._encode(_MARK)
        self.by_word = len(mark) == 1 and self._encode(f" b a\n{_MARK} c ") == [*self._encode("b"), *self._encode("a"), *mark, *self._encode("c")]
        self.lowers = self._encode("AB Cd") == self._encode("ab cd")
        self.mark = mark[0] if mark else -1
        self.kind = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.tails, self.bare = Memo(self._bytes, 10_000), self._model_alone()

    def _model_alone(self):
        """The tokenizer's model without its normalizer and its splitting, where these let lower-case Latin letters pass as they are
        (in the letters of their bytes) and split them from marks; else None."""
        from tokenizers import Tokenizer

        spec = json.loads(self.tok.to_str())
        model = spec["model"]
        if (spec["normalizer"], spec["pre_tokenizer"]) != (_NORMALIZER, _SPLITTING) or model["type"] != "BPE" or not model["end_of_word_suffix"]:
            return None
        self.ends = np.zeros(max(model["vocab"].values()) + 1 + len(spec["added_tokens"]), bool)
        self.ends[[i for word, i in model["vocab"].items() if word.endswith(model["end_of_word_suffix"])]] = True
        return Tokenizer(self.tok.model)

    def _encode(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without offsets, which aren't used

    def _bytes(self, word: bytes) -> bytes:
        return np.array(self._encode(word.decode()), self.kind).tobytes()

    def learn(self, words: set) -> None:
        """Bring words that the memo lacks into it."""
        new = set(words)
        if len(self.memo) + len(new) > TOKEN_MEMO:
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        memo.update((w, old[w]) for w in new if w in old)
        new = {w for w in new if w not in memo}
        if self.bare is not None:  # letters and the marks after them are encoded apart
            cores = {w: core for w in new if (core := w.rstrip(_MARKS)) and (core.isalpha() and core.islower() or _LETTERS.fullmatch(core))}
            letters = {core for core in cores.values() if core not in memo}
            memo.update((w, old[w]) for w in letters if w in old)
            self._learn_letters([w for w in letters if w not in memo])
            memo.update((w, memo[core] + self.tails[w[len(core) :]]) for w, core in cores.items() if len(w) > len(core))
            new.difference_update(cores)
        plain = [w for w in new if b"|" not in w]
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            self._learn_cut(some, self._encode(f" {_MARK} ".join(w.decode() for w in some)))
        memo.update((w, self._bytes(w)) for w in new if w not in memo)

    def _learn_letters(self, words: list[bytes]) -> None:
        """Words of letters only: each is one word for the model, whose last token ends a word."""
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            ids = np.array(self.bare.encode_batch_fast([[w.decode() if w.isascii() else w.decode().translate(_BYTE_LETTERS) for w in some]], is_pretokenized=True, add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                self._add(some, ids, np.append(0, ends[:-1]), ends)
        self.memo.update((w, self._bytes(w)) for w in words if w not in self.memo)

    def _learn_cut(self, words: list[bytes], ids: list[int]) -> None:
        """Words whose ids are set apart by marks."""
        ids = np.array(ids, self.kind)
        cuts = np.flatnonzero(ids == self.mark)
        if len(cuts) == len(words) - 1:
            self._add(words, ids, np.append(0, cuts + 1), np.append(cuts, len(ids)))

    def _add(self, words: list[bytes], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        data, edge = ids.tobytes(), self.kind.itemsize
        self.memo.update(zip(words, map(data.__getitem__, map(slice, (starts * edge).tolist(), (ends * edge).tolist())), strict=True))

    def _cased(self, text: bytes) -> bytes:
        # A lower-cased word has the ids of the word, unless it may be a special token or compose with a combining mark.
        return text.lower() if self.lowers and b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text else text

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text. Long texts are read in runs, if words are encoded independently."""
        if not self.by_word:
            return [np.array(self._encode(t.decode()), self.kind) for t in texts]
        if any(len(t) > RUN_BYTES for t in texts):
            return [np.concatenate([np.empty(0, self.kind), *(self._encode_short([run])[0] for run in text_runs(t))]) for t in texts]
        return self._encode_short(texts)

    def _encode_short(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each distinct word of the texts is looked up once; then all ids are gathered at a time."""
        split = pc.ascii_split_whitespace(pa.array(map(self._cased, texts), pa.binary()).cast(pa.string()))
        coded = split.values.dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()  # a fraction of to_pylist's time
        found = list(map(self.memo.get, words))
        if None in found:
            self.learn({w for w, x in zip(words, found, strict=True) if x is None})
            found = [self.memo[w] if x is None else x for w, x in zip(words, found, strict=True)]
        ids, size = np.frombuffer(b"".join(found), self.kind), np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        number = coded.indices.to_numpy()
        times = size[number]
        end = np.cumsum(times)
        out = ids[np.arange(times.sum()) + np.repeat((np.cumsum(size) - size)[number] - end + times, times)]
        return np.split(out, np.append(0, end)[split.offsets.to_numpy()[1:-1]]) if texts else []


def tokenizer_for(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a worker, so that they share its memo."""
    return kept(("words", path), lambda: WordTokenizer(path))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(docs: DataFrame, tokenizer_path: str, window: int, end_id: int) -> DataFrame:
    """(doc_id, n, fulls: crc of each whole window, rest: the ids after them, rest_crc) of each row, a null text as empty."""

    def make():
        tok = tokenizer_for(tokenizer_path)

        def work(texts: list, batch: pa.RecordBatch) -> dict:
            out = {"doc_id": batch["doc_id"], "n": [], "fulls": [], "rest": [], "rest_crc": []}
            for ids in tok.encode(texts):
                ids = np.append(ids, ids.dtype.type(end_id))
                whole = len(ids) // window * window
                out["n"].append(len(ids))
                out["fulls"].append([crc(ids[i : i + window]) for i in range(0, whole, window)])
                out["rest"].append(ids[whole:].tobytes())
                out["rest_crc"].append(crc(ids[whole:]))
            return out

        return work

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), make, "doc_id long, n long, fulls array<long>, rest binary, rest_crc long", keeps=True)


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Rows of two or three lengths, descending and padded with 0, that sum to the window and occur. Only such rows are made."""
    a = np.arange(1, window)
    pairs = np.stack([a, window - a, 0 * a], 1)
    low = -(-(window - a) // 2)  # of the second length; the third, the rest, isn't larger
    times = np.maximum(np.minimum(a, window - 1 - a) - low + 1, 0)
    x, y = np.repeat(a, times), np.arange(times.sum()) + np.repeat(low - np.cumsum(times) + times, times)
    found = np.concatenate([pairs[pairs[:, 0] >= pairs[:, 1]], np.stack([x, y, window - x - y], 1)])
    return found[present[found].all(1)]


def least_squares(combos: np.ndarray, histogram: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Repeats x >= 0 that bring combos' use of each length close to the histogram, by multiplicative updates (each lowers
    the squared error and keeps x non-negative)."""
    size = len(histogram)
    used = lambda x: sum(np.bincount(combos[:, i], x, size) for i in range(3)) * (np.arange(size) > 0)
    back = lambda v: v[combos].sum(1)
    target = back(histogram * (np.arange(size) > 0))
    x = np.full(len(combos), histogram.sum() / max(3 * len(combos), 1))
    for _ in range(rounds):
        x *= target / np.maximum(back(used(x)), 1e-12)
    return x


@dataclass
class Plan:
    """Slots of each length: the i-th rest of length l goes to the slot whose upper end `until` is the first above i."""

    first: np.ndarray
    until: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence (-1: none) and offset there."""
        big = np.int64(1) << 40  # until and index stay far below; one search serves all lengths
        key = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * big + self.until
        at = np.searchsorted(key, length * big + index, "right")
        ok = at < self.first[length + 1]
        at = np.where(ok, at, 0)
        if not len(self.until):
            return np.full(len(length), -1), np.zeros(len(length), np.int64)
        before = np.where(at > self.first[length], self.until[at - 1], 0)
        return np.where(ok, self.sequence[at] + index - before, -1), np.where(ok, self.offset[at], 0)


def make_plan(histogram: np.ndarray, window: int) -> Plan:
    """histogram: how many rests have each length from 0 to window - 1."""
    combos = combinations(window, np.concatenate([[True], histogram[1:] > 0]))
    x = least_squares(combos, histogram.astype(float))
    left, order, chosen = histogram.astype(np.int64).tolist(), np.argsort(-x, kind="stable"), []

    def wishes():
        for at in range(0, len(order), 4096):  # a list of all takes many times their arrays' memory
            some = order[at : at + 4096]
            yield from zip(some.tolist(), combos[some].tolist(), x[some].tolist(), strict=True)

    for upwards in (False, True):  # whole counts first, then one more of each while there are rests
        for c, (a, b, d), wish in wishes():
            n = 1 if upwards else int(wish)
            if n == 0:
                break
            used = [y for y in (a, b, d) if y]
            n = min(n, *(left[y] // used.count(y) for y in set(used)))
            if n > 0:
                chosen.append((c, n))
                for y in used:
                    left[y] -= n
    slots, sequences = [[] for _ in range(window + 1)], 0
    for c, n in chosen:
        offset = 0
        for y in combos[c].tolist():
            if y:
                slots[y].append((n, sequences, offset))
                offset += y
        sequences += n
    flat = [s for own in slots for s in own]
    counts = np.array([s[0] for s in flat], np.int64)
    first = np.cumsum([0, *(len(own) for own in slots)])
    total = np.cumsum(counts)
    until = total - np.repeat(np.concatenate([[0], total])[first[:-1]], np.diff(first)) if len(flat) else counts
    return Plan(first, until, np.array([s[1] for s in flat], np.int64), np.array([s[2] for s in flat], np.int64), sequences)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, bucket_rows: int = 4_000) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text has the end id alone. Every row is packed for itself, so repeated rows give repeated pieces in
    different places; an empty table gives none. Long texts are cut into whole windows and a rest. Other columns aren't read.
    Rests are numbered within (bucket, length) and shifted by the counts of the buckets before, so no length, however common,
    is gathered in one task.
    """
    spark = docs.sparkSession
    facts = stored(tokenised(docs, tokenizer_path, window, end_id).withColumn("uid", F.monotonically_increasing_id()), "tokens")
    length = (F.col("n") % window).cast("long")
    buckets = max(1, -(-facts.count() // bucket_rows))
    rows = facts.select("uid", "doc_id", "n", "fulls", "rest_crc", length.alias("length"), (F.col("n") / window).cast("long").alias("whole"), F.pmod(F.xxhash64("uid"), F.lit(buckets)).alias("bucket"))
    in_bucket = Window.partitionBy("bucket").orderBy("uid")
    shift = lambda what: F.sum(what).over(Window.orderBy("bucket")) - F.col(what)  # noqa: E731  one row a bucket
    wholes = rows.groupBy("bucket").agg(F.sum("whole").alias("wholes")).select("bucket", shift("wholes").alias("whole_base"))
    by_length = rows.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("rests"))
    bases = by_length.select("bucket", "length", (F.sum("rests").over(Window.partitionBy("length").orderBy("bucket")) - F.col("rests")).alias("rest_base"))
    numbered = (
        rows.withColumn("whole_at", F.sum("whole").over(in_bucket) - F.col("whole"))
        .withColumn("rest_at", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("uid")) - 1)
        .join(wholes, "bucket").join(bases, ["bucket", "length"])
        .select("uid", "doc_id", "n", "fulls", "rest_crc", "length", "whole", "bucket", (F.col("whole_base") + F.col("whole_at")).alias("whole_at"), (F.col("rest_base") + F.col("rest_at")).alias("rest_at"))
    )
    counted = {r["length"]: r["rests"] for r in by_length.groupBy("length").agg(F.sum("rests").alias("rests")).collect()}  # at most `window` rows
    plan = make_plan(np.array([counted.get(y, 0) if y else 0 for y in range(window)]), window)
    shared = spark.sparkContext.broadcast(plan)  # bounded by the number of combinations

    def place(batches):
        for batch in batches:
            cols = {f: batch.column(f) for f in batch.schema.names if f not in ("rest_at",)}
            at, offset = shared.value.place(batch.column("length").to_numpy(zero_copy_only=False), batch.column("rest_at").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": pa.array(at, pa.int64()), "offset": pa.array(offset, pa.int64())})

    placed = stored(numbered.mapInArrow(place, "uid long, doc_id long, n long, fulls array<long>, rest_crc long, length long, whole long, bucket long, whole_at long, sequence_id long, offset long"), "placed")
    # the greedy stream of the rests without a slot
    loose = placed.where("sequence_id < 0 and length > 0").select("uid", "doc_id", "n", "rest_crc", "length", "bucket")
    sums = loose.groupBy("bucket").agg(F.sum("length").alias("sum")).select("bucket", shift("sum").alias("base"))
    stream = loose.withColumn("at", F.sum("length").over(in_bucket) - F.col("length")).join(sums, "bucket").withColumn("at", F.col("at") + F.col("base"))
    stream = stored(stream.select("uid", "doc_id", "n", "rest_crc", "length", (F.col("at") / window).cast("long").alias("sequence_id"), (F.col("at") % window).alias("offset")), "stream")
    crosses = F.col("offset") + F.col("length") > window
    last = stream.agg(F.max(F.col("sequence_id") + crosses.cast("long"))).first()[0]
    loose_sequences = 0 if last is None else last + 1

    def halves(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, room = np.frombuffer(r["rest"], f"<u{len(r['rest']) // r['length']}"), window - r["offset"]
                start = r["n"] - r["length"]
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": r["doc_id"], "start": start, "length": room, "ids_crc32": crc(ids[:room]), "doc_tokens": r["n"], "sequence_id": r["sequence_id"], "offset": r["offset"]},
                     {"doc_id": r["doc_id"], "start": start + room, "length": r["length"] - room, "ids_crc32": crc(ids[room:]), "doc_tokens": r["n"], "sequence_id": r["sequence_id"] + 1, "offset": 0}],
                    schema=piece_schema)

    piece = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    piece_schema = pa.schema([(f.split()[0], pa.int64()) for f in piece.split(", ")])
    cut = stored(stream.where(crosses).drop("rest_crc"), "cut")
    cut_pieces = cut.join(facts.select("uid", "rest"), "uid").mapInArrow(halves, piece)
    names = [f.split()[0] for f in piece.split(", ")]
    as_piece = lambda df, first: df.select("doc_id", (F.col("n") - F.col("length")).alias("start"), "length", F.col("rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("sequence_id") + first).alias("sequence_id"), "offset")
    fulls = placed.select("doc_id", "n", "whole_at", F.posexplode("fulls").alias("i", "ids_crc32"))
    fulls = fulls.select("doc_id", (F.col("i") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), (F.col("whole_at") + F.col("i") + plan.sequences + loose_sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return (
        as_piece(placed.where("sequence_id >= 0 and length > 0"), 0)
        .unionByName(as_piece(stream.where(~crosses), plan.sequences))
        .unionByName(cut_pieces.select(*names).withColumn("sequence_id", F.col("sequence_id") + plan.sequences))
        .unionByName(fulls)
    )
