"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Each group of rows (a *sender*) sends the sorted set of its fingerprints, Golomb-Rice coded, to the owners of the
fingerprint ranges. An owner merges what it gets, and answers each sender with a bitmap: bit i is set if the i-th
fingerprint of that message is also held by another sender. Only rows with such a fingerprint, or with one that
occurs twice within its own sender, are suspects. A bitmap of the suspects' fingerprints, of bounded size, goes to all tasks:
the scan of the texts lets through the suspects, and of the others a share that grows with the bitmap's filling. These alone are
shuffled with their texts, and grouped by the whole text, so that equal fingerprints of different texts never merge.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

#: Bits of a fingerprint that take part in the exchange. False suspects only cost a text comparison.
FINGERPRINT_BITS = 48
#: Bits of the suspects' bitmap for each suspect, and at most (16 MB).
BITS_EACH, MOST_BITS = 64, 1 << 27
#: Fingerprints of an owner, and rows of a sender: at least so many, and so many for each owner, that messages stay worth coding.
OWNER_FINGERPRINTS, SENDER_ROWS, MESSAGE_FINGERPRINTS = 1 << 23, 1 << 12, 256
LEAST_OWNERS = 8


def golomb_encode(values: np.ndarray) -> bytes:
    """Golomb-Rice code of a strictly increasing uint64 array: first the Rice parameter, then unary quotients, then
    the remainders, all packed in bits."""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(-1)) - 1
    k = max(0, int(np.log2(max(1.0, float(gaps.mean()) * 0.69)))) if len(gaps) else 0
    q = gaps >> k
    unary = np.ones(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 0
    rest = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8).ravel()
    return bytes([k]) + np.packbits(np.concatenate([unary, rest])).tobytes()


def golomb_decode(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.empty(0, np.int64)
    k, bits = data[0], np.unpackbits(np.frombuffer(data, np.uint8, offset=1))
    ends = np.flatnonzero(bits == 0)[:count]
    q = np.diff(ends, prepend=-1) - 1
    start = int(ends[-1]) + 1
    rest = bits[start : start + count * k].reshape(count, k).astype(np.int64)
    low = rest @ (np.int64(1) << np.arange(k, dtype=np.int64)) if k else np.zeros(count, np.int64)
    return np.cumsum(((q.astype(np.int64) << k) | low) + 1) - 1


def suspect_fingerprints(rows: DataFrame, owners: int) -> DataFrame:
    """rows: (sender, fp) with fp in [0, 2**FINGERPRINT_BITS). Returns the distinct fingerprints that more than one row
    may hold. A message has at most one entry for each row of its sender, so a hot text costs one entry a sender."""
    width = (1 << FINGERPRINT_BITS) // owners + 1

    def send(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fps, n = np.unique(pdf["fp"].to_numpy(np.int64), return_counts=True)
        out, owner = [], fps // width
        for o in np.unique(owner):
            mine = owner == o
            out.append((int(o), int(key[0]), int(mine.sum()), golomb_encode(fps[mine]), np.packbits(n[mine] > 1).tobytes()))
        return pd.DataFrame(out, columns=["owner", "sender", "n", "coded", "own"])

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [golomb_decode(c, n) for c, n in zip(pdf["coded"], pdf["n"], strict=True)]
        every, count = np.unique(np.concatenate(lists), return_counts=True)
        twice = every[count > 1]
        bitmaps = []
        for fps, own in zip(lists, pdf["own"], strict=True):
            at = np.searchsorted(twice, fps)
            shared = (at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == fps) if len(twice) else np.zeros(len(fps), bool)
            bitmaps.append((np.packbits(shared) | np.frombuffer(own, np.uint8)).tobytes())
        return pd.DataFrame({"sender": pdf["sender"], "owner": pdf["owner"], "n": pdf["n"], "bitmap": bitmaps})

    def receive(key: tuple, mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(mine["fp"].to_numpy(np.int64))
        flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in answers.sort_values("owner")[["bitmap", "n"]].itertuples(index=False)]
        return pd.DataFrame({"fp": fps[np.concatenate(flags)] if flags else fps[:0]})

    messages = rows.groupBy("sender").applyInPandas(send, "owner long, sender long, n long, coded binary, own binary")
    answers = messages.groupBy("owner").applyInPandas(answer, "sender long, owner long, n long, bitmap binary")
    return rows.groupBy("sender").cogroup(answers.groupBy("sender")).applyInPandas(receive, "fp long").distinct()


def bitmap_of(suspects: DataFrame) -> np.ndarray:
    """A bitmap, as bytes, in which the bit of every suspect (fp) is set; its size is a power of two."""
    bits = min(MOST_BITS, 1 << max(10, (BITS_EACH * suspects.count()).bit_length()))
    place = F.pmod(F.xxhash64("fp"), F.lit(bits))
    words = suspects.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("set"))
    got = words.toArrow()  # at most MOST_BITS / 64 rows
    out = np.zeros(bits // 64, "<i8")
    out[got["word"].to_numpy()] = got["set"].to_numpy()
    return out.view(np.uint8)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_sender: int | None = None) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest id stays; a null text counts as empty, and null ids lose against others. Rows that repeat
    both id and text belong to the same group and are all marked kept (they are the same document). An empty table gives
    an empty result. Only the two named columns are read, so other columns can have any names.

    Scale: the first pass keeps about 60 bytes a row. Senders and owners are groups of bounded size. Suspects' texts are counted
    on the map side before they are shuffled, so each task sends a text that fills a third of the rows once. With more suspects
    than the bitmap was made for (MOST_BITS / BITS_EACH), more of the other texts are shuffled too; results stay the same.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    sha = F.sha2(F.col("text"), 256)
    fp = F.shiftrightunsigned(F.xxhash64("text"), 64 - FINGERPRINT_BITS)
    facts = stored(texts.select(F.monotonically_increasing_id().alias("uid"), "doc_id", sha.alias("text_sha256"), fp.alias("fp")), "facts")
    n = facts.count()
    owners = max(LEAST_OWNERS, -(-n // OWNER_FINGERPRINTS))
    senders = max(1, -(-n // (rows_per_sender or max(SENDER_ROWS, MESSAGE_FINGERPRINTS * owners))))
    suspects = stored(suspect_fingerprints(facts.select(F.pmod(F.xxhash64("uid"), F.lit(senders)).alias("sender"), "fp"), owners), "suspects")
    bitmap = spark.sparkContext.broadcast(bitmap_of(suspects))

    @F.pandas_udf("boolean")
    def may_repeat(place: pd.Series) -> pd.Series:
        at = place.to_numpy(np.int64) & (8 * len(bitmap.value) - 1)
        return pd.Series((bitmap.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    verified = (
        texts.withColumn("place", F.xxhash64(fp)).where(may_repeat("place"))
        .groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1").select(sha.alias("text_sha256"), "keep_id", "group_size")
    )
    keep = F.coalesce("keep_id", "doc_id")
    return facts.join(stored(verified, "verified"), "text_sha256", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
