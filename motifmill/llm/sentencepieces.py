"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search runs over the positions of a text. A state is a position and the last piece of its path; a piece may follow another
if the merges of the two pieces' text would keep them apart, so the one path through admissible steps is exactly what the
library's merging finds. Only positions within the longest piece's reach of the newest one can still be extended; when all their
backpointer paths meet in one boundary, the ids before it are committed and forgotten. No piece goes over the start of a run of
spaces, over a border of letters and other characters that no piece holds, or over a character without a piece, so there all
paths meet by construction: a text is searched between such places, and the ids of short stretches are memoised. New stretches
of a batch are searched in order, and each goes on from the states that it shares with the one before.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RUN_BYTES, Memo, map_texts, text_of

SPACE = "▁"
#: Stretches up to this length are memoised.
MEMO_CHARS = 48


class PieceCoder:
    """Encodes and decodes texts with a SentencePiece model of merges with byte fallback."""

    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)]
        pieces = [sp.id_to_piece(i) for i in range(size)]
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i] and not sp.is_byte(i)}
        self.pieces = pieces
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        #: When merging makes a piece (-1: a single character), and the two pieces it is made of.
        self.made, self.left, self.right = [-1.0] * size, [0] * size, [0] * size
        for p in [p for p in self.ids if len(p) > 1]:
            parts = self.merged(p)
            if len(parts) == 2:
                i = self.ids[p]
                self.made[i], self.left[i], self.right[i] = self.rank[p], self.ids[parts[0]], self.ids[parts[1]]
            else:  # merging never gets to this piece
                del self.ids[p]
        #: The piece (-1: none) for every end of a piece.
        self.ends = {p[i:]: self.ids.get(p[i:], -1) for p in self.ids for i in range(len(p))}
        self.text = [b"" if special[i] else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece goes over the start of a run of spaces")
        self.apart = Memo(self._apart, 1_000_000)
        self.memo = Memo(self.searched)
        self.stretch = self._stretches()

    def _stretches(self) -> re.Pattern:
        """Spaces and the letters, or the other characters, that follow. A text may be cut between two characters that stand beside
        each other in no piece, since every merge over their border would make such a piece. Letters that have pieces with
        others count as others; without such borders only runs of spaces start a stretch."""
        pairs = {pair for p in self.ids for pair in zip(p, p[1:], strict=False) if pair[0] != SPACE or pair[1] == "\n"}
        letter = re.compile(r"[^\W\d_]")
        mixed = {c for pair in pairs for c in pair if len({bool(letter.match(x)) for x in pair}) == 2 and letter.match(c)}
        odd = "".join(map(re.escape, sorted(mixed)))
        if any(("\n" in pair) or (pair[0] in mixed) != (pair[1] in mixed) and all(map(letter.match, pair)) for pair in pairs):
            return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        return re.compile(rf"{SPACE}*[^\W\d_{odd}]+|{SPACE}*(?:[^\w{SPACE}\n]|[\d_{odd}])+|{SPACE}+|\n")

    def merged(self, text: str) -> list[str]:
        """Plain merging of a piece's text up to its last step: always the pair whose whole has the best score, the leftmost
        first."""
        parts = list(text)
        while len(parts) > 2:
            best = min((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == np.inf:
                break
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
        return parts

    def _apart(self, pair: int) -> bool:
        """Whether merging keeps two neighbouring pieces apart: no two pieces that stood at their border at any time have a
        whole that was due before one of them was merged further. Walks back through the merges on both sides."""
        a, b, before = pair >> 32, pair & 0xFFFFFFFF, np.inf
        while True:
            whole = self.rank.get(self.pieces[a] + self.pieces[b])
            if whole is not None and whole < before:
                return False
            if self.made[a] > self.made[b]:
                before, a = self.made[a], self.right[a]
            elif self.made[b] >= 0:  # of two equal merges the left one comes first
                before, b = self.made[b] + 0.5, self.left[b]
            else:
                return True

    def search(self, text: str) -> list[int]:
        """The ids of a stretch of text."""
        ends, apart, reach = self.ends.get, self.apart, self.longest
        out: list[int] = []
        base, last, back = 0, [-1], [0]  # last[p - base], back[p - base]: the piece that ends at p, and where it starts
        for p in range(1, len(text) + 1):
            for q in range(p - 1, base - 1, -1):
                piece = ends(text[q:p])
                if piece is None:
                    break
                if piece >= 0 and ((before := last[q - base]) < 0 or apart[before << 32 | piece]):
                    last.append(piece)
                    back.append(q)
                    break
            if len(last) == p - base:  # a character without a piece ends all paths
                out += self._path(last, back, base, p - 1)
                out += [self.bytes[b] for b in text[p - 1].encode()]
                base, last, back = p, [-1], [p]
                continue
            if p - base >= 8 * reach:
                alive = set(range(p - reach + 1, p + 1))
                while len(alive) > 1:
                    newest = max(alive)
                    alive.remove(newest)
                    alive.add(back[newest - base])
                meet = alive.pop()
                if meet > base:
                    out += self._path(last, back, base, meet)
                    last, back, base = last[meet - base :], back[meet - base :], meet
        return out + self._path(last, back, base, len(text))

    def searched(self, text: str) -> bytes:
        return array("i", self.search(text)).tobytes()

    def search_sorted(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of short stretches in order: the states up to where one differs from the one before are still those of its
        own search. One with a character that has no piece is searched alone."""
        ends, apart = self.ends.get, self.apart
        before, last, back = "", [-1], [0]
        for text in texts:
            shared = 0
            for a, b in zip(before, text, strict=False):
                if a != b:
                    break
                shared += 1
            shared = min(shared, len(last) - 1)
            del last[shared + 1 :], back[shared + 1 :]
            for p in range(shared + 1, len(text) + 1):
                for q in range(p - 1, -1, -1):
                    piece = ends(text[q:p])
                    if piece is None:
                        break
                    if piece >= 0 and ((to := last[q]) < 0 or apart[to << 32 | piece]):
                        last.append(piece)
                        back.append(q)
                        break
                if len(last) == p:
                    yield self.searched(text)
                    break
            else:
                yield array("i", self._path(last, back, 0, len(text))).tobytes()
            before = text

    @staticmethod
    def _path(last: list[int], back: list[int], base: int, end: int) -> list[int]:
        path = []
        while end > base:
            path.append(last[end - base])
            end = back[end - base]
        return path[::-1]

    _BORDER = re.compile(f"[^ {SPACE}\\n](?= )")

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; none for an empty one. A long text is read in runs that end before a run of spaces."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text of a batch; runs are encoded together up to some RUN_BYTES."""
        coded, ends, runs, size = [], [0], [], 0
        for text in texts:
            at = 0
            while at < len(text):
                found = self._BORDER.search(text, at + RUN_BYTES) if len(text) > at + RUN_BYTES else None
                end = found.end() if found else len(text)
                runs.append(((SPACE if at == 0 else "") + text[at:end]).replace(" ", SPACE))
                size, at = size + end - at, end
                if size >= RUN_BYTES:
                    coded += self._encode(runs)
                    runs, size = [], 0
            ends.append(len(coded) + len(runs))
        coded += self._encode(runs)
        return [np.frombuffer(b"".join(coded[at:end]), "<i4") for at, end in pairwise(ends)]

    def _encode(self, runs: list[str]) -> list[bytes]:
        split = list(map(self.stretch.findall, runs))
        ids = dict.fromkeys(chain.from_iterable(split))
        memo, new = self.memo, []
        for s in ids:
            found = memo.get(s) or memo.old.get(s)
            if found is not None:
                ids[s] = found
            elif len(s) <= MEMO_CHARS:
                new.append(s)
            else:
                ids[s] = self.searched(s)
        new.sort()
        ids.update(zip(new, self.search_sorted(new), strict=True))
        for s in new:
            memo.put(s, ids[s])
        return [b"".join(map(ids.__getitem__, own)) for own in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as UTF-8; the space that encoding puts in front goes."""
        return b"".join(map(self.text.__getitem__, ids.tolist())).removeprefix(b" ")


@lru_cache(maxsize=2)
def coder_for(model_path: str) -> PieceCoder:
    """One coder for all tasks of a worker, so that they share its memo."""
    return PieceCoder(model_path)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) of each row. A null or empty text has no ids; repeated rows repeat theirs; an empty table gives none."""

    def make():
        coder = coder_for(model_path)
        return lambda texts, batch: {"doc_id": batch["doc_id"], "ids": coder.encode_all([t.decode() for t in texts])}

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text, an id outside the vocabulary is an error."""

    def run(batches):
        coder = coder_for(model_path)
        for batch in batches:
            ids = batch.column("ids")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([coder.decode(np.array(x.as_py() or [], "<i4")).decode("utf-8", "replace") for x in ids], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """One row a document: doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_sha256, same_text.

    Encodes and decodes each whole text, a null one as empty. The text comes back as it was, but that the character U+2581
    comes back as a space. Columns other than doc_id and text aren't read.
    """

    def make():
        import hashlib

        coder = coder_for(model_path)

        def work(texts: list, batch: pa.RecordBatch) -> dict:
            out = {"doc_id": batch["doc_id"], "n_ids": [], "ids_crc32": [], "decoded_sha256": [], "same_text": []}
            for t, ids in zip(texts, coder.encode_all([t.decode() for t in texts]), strict=True):
                back = coder.decode(ids)
                out["n_ids"].append(len(ids))
                out["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                out["same_text"].append(back == t)
            return out

        return work

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), make, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, same_text boolean")
