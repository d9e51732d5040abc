"""Byte-pair encoding and decoding with a lexicon compiled into a minimal acyclic transducer.

The corpus's most frequent words (all texts are counted) are merged once on the driver and compiled into an automaton that shares
prefixes and suffixes. Its arcs carry numbers that add up to a word's place in the lexicon, where its ids are. The file goes to
every executor once (`SparkContext.addFile`, from the shared folder) and is mapped into memory, so all workers of a machine share
its pages. A batch's distinct words walk through the automaton together, one byte a step; words that it doesn't hold are merged
exactly. The lexicon only decides which words are looked up: results are the same with any.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, new_path, small_batches, stored, text_of, text_runs

#: Words of the lexicon: about so many of the most frequent ones, found twice at least, of at most so many bytes.
LEXICON_WORDS = 1 << 16
LEAST_COUNT = 2
WORD_BYTES = 64
#: Distinct words that a task counts before it hands its counts on.
COUNTED_WORDS = 400_000
#: Words of a worker's memo, and their letters in all; as many old ones.
RECENT_WORDS, RECENT_LETTERS = 150_000, 1 << 24
#: Characters of a text that are split into words at a time.
RUN_CHARS = 1 << 20
#: Bytes of a word above which the next merge is found by a heap, and shorter words that are merged together.
SHORT_WORD = 48
SIDE_BY_SIDE = 4096
#: Fixed value: the pattern that splits text in front of byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = regex.compile(PATTERN)
_ID_BITS = 24
_ID, _NEVER = (1 << _ID_BITS) - 1, 1 << 62
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_CUT = regex.compile(r"(?<=\S)(?=\s)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if it is printable and no space, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Vocabulary:
    """Pieces, merges and special tokens of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, before = data["model"], data["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not (model.get("dropout") or model.get("unk_token") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        if not plain or data["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path} isn't a byte-level vocabulary without a normalizer and prefix space")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"] for t in data["added_tokens"]):
            raise ValueError(f"{path} has special tokens that take white space or whole words only")
        letters, ids = byte_letters(), model["vocab"]
        value = {c: b for b, c in enumerate(letters)}
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.pieces = [b""] * (max([*ids.values(), *self.specials.values()]) + 1)
        for piece, i in ids.items():
            self.pieces[i] = bytes(value[c] for c in piece)
        for piece, i in self.specials.items():
            self.pieces[i] = piece.encode()
        self.bytes = [ids[c] for c in letters]
        self.merges: dict[tuple[int, int], int] = {}  # of a pair of ids the merge's rank and, in the low bits, the id that it makes
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = rank << _ID_BITS | ids[a + b]
        pairs = sorted((a << _ID_BITS | b, code) for (a, b), code in self.merges.items())
        self.pairs, self.codes = np.array([k for k, _ in pairs] or [-1], np.int64), np.array([c for _, c in pairs] or [_NEVER], np.int64)
        self.letters = np.array(self.bytes, np.int64)
        longest_first = sorted(self.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: of all adjacent pairs the one merged earliest in the vocabulary goes first, the leftmost of equals."""
        if len(word) > SHORT_WORD:
            return self._merge_long([self.bytes[b] for b in word])
        return self.merge_many([word])[0].view("<u4").tolist()

    def _codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of ids the rank and result of their merge, _NEVER where there is none."""
        key = a << _ID_BITS | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.codes[at], _NEVER)

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of short words, as bytes. Every round does each word's next merge, in all words at once; symbols are linked lists in
        the rows of a matrix."""
        out: list[np.ndarray] = [np.empty(0, np.uint8)] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for first in range(0, len(order), SIDE_BY_SIDE):
            some = order[first : first + SIDE_BY_SIDE]
            size = np.fromiter((len(words[i]) for i in some), np.int64, len(some))
            n, width = len(some), int(size[-1])
            used = np.arange(width) < size[:, None]
            ids = np.full((n, width + 1), -1, np.int64)  # the last column ends all lists
            ids[:, :width][used] = self.letters[np.frombuffer(b"".join(words[i] for i in some), np.uint8)]
            codes = self._codes(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
            after, before = np.tile(np.arange(1, width + 2), (n, 1)), np.tile(np.arange(-1, width), (n, 1))
            rows = np.arange(n)
            while len(rows):
                at = codes[rows].argmin(1) if width else rows
                best = codes[rows, at] if width else np.full(n, _NEVER)
                going = best != _NEVER
                rows, at, best = rows[going], at[going], best[going]
                gone = after[rows, at]
                nxt, prior = after[rows, gone], before[rows, at]
                ids[rows, at], used[rows, gone], codes[rows, gone] = best & _ID, False, _NEVER
                after[rows, at], before[rows, np.minimum(nxt, width)] = nxt, at
                codes[rows, at] = self._codes(ids[rows, at], ids[rows, np.minimum(nxt, width)])
                led = prior >= 0
                codes[rows[led], prior[led]] = self._codes(ids[rows[led], prior[led]], ids[rows[led], at[led]])
            raw, ends = ids[:, :width][used].astype("<u4").view(np.uint8), 4 * np.cumsum(used.sum(1))
            for i, a, b in zip(some, [0, *ends.tolist()], ends.tolist(), strict=False):
                out[i] = raw[a:b]
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list: each entry holds a rank and a place, and is stale once its pair is gone."""
        get, n = self.merges.get, len(ids)
        after, before, shift = np.arange(1, n + 1).tolist(), np.arange(-1, n - 1).tolist(), n.bit_length()
        heap = [(get(p) << shift) | i for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & ((1 << shift) - 1)
            j = after[i]
            if ids[i] < 0 or j >= n or get((ids[i], ids[j])) != entry >> shift:
                continue
            ids[i], ids[j] = entry >> shift & _ID, -1
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (found := get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (found << shift) | i)
            if h >= 0 and (found := get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (found << shift) | h)
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the pieces; ids without a piece have none."""
        pieces, n = self.pieces, len(self.pieces)
        try:
            return b"".join(map(pieces.__getitem__, ids))
        except IndexError:
            return b"".join(pieces[i] for i in ids if i < n)


def runs(text: str, size: int | None = None) -> Iterator[str]:
    """A text in runs that end before white space which follows something else, where a word always ends."""
    at, size = 0, size or RUN_CHARS
    while at < len(text):
        found = _CUT.search(text, at + size) if at + size < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def split(text: str, vocabulary: Vocabulary, size: int | None = None) -> Iterator[list[str] | int]:
    """The words of a text as lists, and special tokens as ids between them."""
    special = vocabulary.special
    for i, part in enumerate(special.splititer(text) if special is not None and special.search(text) else (text,)):
        if i % 2:
            yield vocabulary.specials[part]
        else:
            yield from map(_WORDS.findall, runs(part, size))


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """A file of the minimal acyclic transducer of `words` (sorted, distinct): arcs as sorted keys (256 x state + byte) with their
    targets and numbers, whether states are final, and the words' ids one after another with their ends."""
    states: dict[tuple, int] = {}
    below: list[int] = []
    open_states: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]

    def close() -> int:
        final, arcs = open_states.pop()
        state = states.setdefault((final[0], *arcs), len(states))
        if state == len(below):
            below.append(final[0] + sum(below[t] for _, t in arcs))
        return state

    last = b""
    for word in [*words, b""]:
        same = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        while len(open_states) > same + 1:
            state = close()
            open_states[-1][1].append((last[len(open_states) - 1], state))
        open_states += [([False], []) for _ in word[same:]]
        if word:
            open_states[-1][0][0] = True
        last = word
    root = close()

    keys, targets, numbers, final = [], [], [], np.zeros(len(states), "<u1")
    for (is_final, *arcs), state in states.items():
        number, final[state] = int(is_final), is_final
        for byte, target in arcs:
            keys.append(state << 8 | byte)
            targets.append(target)
            numbers.append(number)
            number += below[target]
    order = np.argsort(np.array(keys, "<i8"), kind="stable")
    arrays = {
        "keys": np.array(keys, "<i8")[order], "targets": np.array(targets, "<i4")[order], "numbers": np.array(numbers, "<i4")[order], "final": final,
        "ends": np.cumsum([0, *map(len, ids)]).astype("<i8"), "ids": np.array([x for one in ids for x in one], "<u4"),
    }
    head = {"root": root, "longest": max(map(len, words), default=0), "arrays": [(n, a.dtype.str, len(a)) for n, a in arrays.items()]}
    start = json.dumps(head).encode()
    return b"".join([f"{len(start):<15}\n".encode(), start, b" " * (-len(start) % 16), *[a.tobytes() + b"\0" * (-a.nbytes % 16) for a in arrays.values()]])


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        size = int(bytes(data[:16]))
        head = json.loads(bytes(data[16 : 16 + size]))
        self.root, self.longest, at = head["root"], head["longest"], 16 + size + -size % 16
        for name, kind, n in head["arrays"]:
            width = np.dtype(kind).itemsize * n
            setattr(self, name, data[at : at + width].view(kind))
            at += width + -width % 16
        self.raw = self.ids.view(np.uint8)

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the lexicon, -1 for others. All words go one byte on at each step."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(words), np.uint8)
        out = np.full(len(words), -1, np.int64)
        at = np.flatnonzero((size > 0) & (size <= self.longest)) if len(self.keys) else np.empty(0, np.int64)
        state, number = np.full(len(at), self.root, np.int64), np.zeros(len(at), np.int64)
        for step in range(self.longest):
            if not len(at):
                break
            key = state << 8 | flat[start[at] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            at, arc = at[found], arc[found]
            state, number = self.targets[arc].astype(np.int64), number[found] + self.numbers[arc]
            ended = size[at] == step + 1
            hit = ended & (self.final[state] == 1)
            out[at[hit]] = number[hit]
            at, state, number = at[~ended], state[~ended], number[~ended]
        return out


class Codec:
    """Encodes and decodes with a vocabulary and a lexicon's file (None: every word is merged)."""

    def __init__(self, path: str, lexicon: str | None = None):
        self.vocabulary = Vocabulary(path)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def codes(self, words: set[str]) -> dict[str, bytes]:
        """A dictionary that holds the ids of all the given words, as little-endian 32-bit integers. It is a memo of recent words: those
        that it lacks are looked up; when it is full, it becomes the old one, from which words still in use come back."""
        if len(self.recent) > RECENT_WORDS or self.held > RECENT_LETTERS:
            self.recent, self.older, self.held = {}, self.recent, 0
        new = words - self.recent.keys()
        back = new & self.older.keys()
        self.recent.update((w, self.older[w]) for w in back)
        self.recent.update(self._looked_up(list(new - back)))
        self.held += sum(map(len, new))
        return self.recent

    def _looked_up(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, from the lexicon or by merging."""
        raw = [w.encode("utf-8", "replace") for w in words]
        places = self.lexicon.places(raw) if self.lexicon is not None else np.full(len(raw), -1, np.int64)
        out: dict[str, bytes] = {}
        known = np.flatnonzero(places >= 0)
        if len(known):
            first, end = self.lexicon.ends[places[known]] * 4, self.lexicon.ends[places[known] + 1] * 4
            size = end - first
            cut = np.cumsum(size)
            picked = self.lexicon.raw[np.repeat(first - (cut - size), size) + np.arange(int(cut[-1]))].tobytes()
            out.update(zip([words[i] for i in known.tolist()], map(picked.__getitem__, map(slice, [0, *cut.tolist()], cut.tolist())), strict=False))
        unseen = np.flatnonzero(places < 0).tolist()
        short = [i for i in unseen if len(raw[i]) <= SHORT_WORD]
        out.update(zip([words[i] for i in short], [x.tobytes() for x in self.vocabulary.merge_many([raw[i] for i in short])], strict=True))
        out.update((words[i], np.array(self.vocabulary.merge(raw[i]), "<u4").tobytes()) for i in unseen if len(raw[i]) > SHORT_WORD)
        return out

    def encode(self, texts: list[str], size: int | None = None) -> list[Iterator[bytes]]:
        """For each text an iterator over the ids of its runs. The words of short texts are looked up together."""
        split_texts = [list(split(t, self.vocabulary, size)) if len(t) <= RUN_CHARS else None for t in texts]
        words: set[str] = set()
        for parts in split_texts:
            words.update(*[part for part in parts or () if not isinstance(part, int)])
        codes = self.codes(words)
        return [self._joined(parts, codes) if parts is not None else self._by_run(text, size) for text, parts in zip(texts, split_texts, strict=True)]

    def _joined(self, parts: list[list[str] | int], codes: dict[str, bytes]) -> Iterator[bytes]:
        for part in parts:
            yield part.to_bytes(4, "little") if isinstance(part, int) else b"".join(map(codes.__getitem__, part))

    def _by_run(self, text: str, size: int | None) -> Iterator[bytes]:
        for part in split(text, self.vocabulary, size):
            yield from self._joined([part], {} if isinstance(part, int) else self.codes(set(part)))

    def decode(self, ids: np.ndarray | memoryview) -> bytes:
        """The decoded text in UTF-8; bytes that aren't become U+FFFD."""
        raw = self.vocabulary.decode(ids.tolist())
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over whole texts: runs of letters, here all bytes but ASCII white space, digits and marks. Each task sums its counts before
    they are shuffled."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def give() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                for run in text_runs(text.as_py()):
                    found.update(run.translate(_LETTERS).split())
                    if len(found) > COUNTED_WORDS:
                        yield give()
        yield give()

    return docs.select(text_of(text_col).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> list[bytes]:
    """At most `most` words of counts (word, n), sorted. The least count is set from a histogram of counts by sixteenths of octaves,
    so no task sends more than its share of these words to the driver."""
    level = F.floor(F.log2("n") * 16)
    above, least = 0, None
    for row in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():  # at most 1024
        above += row["words"]
        if above > most:
            break
        least = row["level"]
    return sorted(bytes(r["word"]) for r in counts.where(level >= least).select("word").collect()) if least is not None else []


def publish_lexicon(docs: DataFrame, path: str, text_col: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of all texts, each with and without a space in front, and give the file to all executors; returns
    its name for `SparkFiles`. At most half as many words as `words`, of WORD_BYTES bytes each, come to the driver."""
    spark = docs.sparkSession
    counts = word_counts(docs, text_col).where(f"n >= {LEAST_COUNT} and length(word) between 1 and {WORD_BYTES}")
    letters = [w.decode("utf-8", "ignore") for w in frequent_words(stored(counts, "words"), words // 2)]
    frequent = sorted({part.encode() for w in letters for part in (*_WORDS.findall(w), *_WORDS.findall(" " + w))})
    data = compile_lexicon(frequent, [ids.view("<u4").tolist() for ids in Vocabulary(path).merge_many(frequent)])
    name = f"lexicon-{uuid.uuid4().hex}"
    file = f"{new_path(spark, 'lexicon')}/{name}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(file)
    out = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(jpath)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(file)
    return name


def _codec(path: str, name: str | None) -> Callable[[], Codec]:
    made: list[Codec] = []

    def get() -> Codec:
        if not made:
            made.append(Codec(path, SparkFiles.get(name) if name else None))
        return made[0]

    return get


def encode_column(spark: SparkSession, text: Column, path: str, lexicon: str | None = None) -> Column:
    """The ids of a text (null: none) as an array."""
    codec = _codec(path, lexicon)
    small_batches(spark)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in codec().encode([t or "" for t in texts])])

    return ids(text)


def decode_column(spark: SparkSession, ids: Column, path: str) -> Column:
    """The text of an array of ids (null: empty)."""
    codec = _codec(path, None)
    small_batches(spark)

    @F.pandas_udf("string")
    def texts(rows: pd.Series) -> pd.Series:
        return pd.Series([codec().decode(np.asarray([] if r is None else r, np.int64)).decode() for r in rows])

    return texts(ids)


def round_trip(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> DataFrame:
    """One row for each row of `docs`: (doc_id, n_tokens, ids_sha256, decoded_sha256) of its text's ids and of the text decoded from them.

    A null text is empty, without ids; null and repeated ids stay rows of their own; an empty table gives no rows. Strings of special
    tokens in a text become these tokens, as in the library. Only doc_id and text are read. Texts are split in runs of RUN_CHARS, so a
    long one takes memory for itself and one run; a single word of n bytes takes some 200 n bytes while it is merged.
    """
    lexicon = publish_lexicon(docs, path, words=words)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def make() -> Callable:
        codec = Codec(path, SparkFiles.get(lexicon))

        def work(texts: list, batch: pa.RecordBatch) -> dict:
            n, coded, back = [], [], []
            for parts in codec.encode([t.decode("utf-8", "replace") for t in texts]):
                tokens, of_ids, of_text = 0, sha256(), sha256()
                for ids in parts:
                    tokens += len(ids) >> 2
                    of_ids.update(ids)
                    of_text.update(codec.decode(np.frombuffer(ids, "<u4")))
                n.append(tokens)
                coded.append(of_ids.hexdigest())
                back.append(of_text.hexdigest())
            return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": coded, "decoded_sha256": back}

        return work

    return map_texts(docs.select("doc_id", text_of().alias("text")), make, schema)
