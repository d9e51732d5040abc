"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share at least 5
positional bytes: of the four bytes of one half they share three or more. Posting lists are therefore kept by three
positions of one half and their bytes, 8 lists a fingerprint; any admissible pair meets in one of them. For pairs that meet,
the shared positional bytes are tallied, pairs under the guaranteed minimum go, and the rest is verified by differing bits.

Only distinct fingerprints are posted, and SHORT_LIST and BLOCK only choose how a list's pairs are compared. Of a long list, the fingerprints near its most frequent member (the pivot) hang on
that, and only the others are compared with the whole list, in blocks, from which a spanning forest comes back rather than
the pairs. Nothing is capped or dropped: every link between different fingerprints lies in one component's edges.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, split_by_marks, stored, text_of, token_runs
from .components import components

MAX_BITS = 3
#: Positional bytes that fingerprints with at most MAX_BITS differing bits share at least.
LEAST_SHARED = 8 - MAX_BITS
#: Lists up to this length are paired by a join, longer ones in blocks of this many rows.
SHORT_LIST = 48
BLOCK = 1024
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)


def fingerprint(text: bytes, ngram: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of an ASCII-lower-cased text's word shingles; 0 without words. Long texts are read in runs."""
    ones, shingles, last = np.zeros(64, np.int64), 0, []
    for run in token_runs(text):
        words = last + run
        if len(words) >= ngram:
            hashes = _shingle_hashes(words, ngram, seed)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            shingles += len(hashes)
        last = words[1 - ngram :] if ngram > 1 else []
    if not shingles:
        if not last:
            return 0
        ones, shingles = np.unpackbits(_shingle_hashes(last, len(last), seed).view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * ones > shingles, bitorder="little").view(np.int64)[0])


def _shingle_hashes(words: list[bytes], size: int, seed: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    pieces = map(joined.__getitem__, map(slice, [0, *ends[:-1]], [e - 1 for e in ends[size - 1 :]]))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, len(words) - size + 1)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, ngram: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; a null text counts as empty."""
    make = lambda: lambda texts, batch: {"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "fp": [fingerprint(t, ngram, seed) for t in texts]}
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), text_of().alias("text")), make, "doc_id long, text_hash long, fp long")


def _postings(fp: Column) -> Column:
    """The 8 list numbers of a fingerprint: 3 of the 4 bytes of a half, with the positions in the upper bits."""
    lists = []
    for k, (half, kept) in enumerate((h, c) for h in (0, 4) for c in combinations(range(4), 3)):
        value = F.lit(k).cast("long")
        for p in kept:
            value = F.shiftleft(value, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * (half + p)).bitwiseAND(F.lit(255)))
        lists.append(value)
    return F.array(*lists)


def tally(a: Column, b: Column) -> Column:
    """Positions at which two fingerprints have the same byte."""
    x = a.bitwiseXOR(b)
    return sum((F.when(F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def _near(a: Column, b: Column) -> Column:
    """Count filter, then verification."""
    return (tally(a, b) >= LEAST_SHARED) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)


def _forest(_key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges of a spanning forest of the links between a block of open rows and a block of all rows."""
    a, b = pdf.loc[pdf["open"], "fp"].to_numpy(np.int64), pdf.loc[~pdf["open"], "fp"].to_numpy(np.int64)
    x = (a[:, None] ^ b[None, :]).view(np.uint64)
    near = np.bitwise_count(~(((x & _LOW7) + _LOW7) | x | _LOW7)) >= LEAST_SHARED  # the tally: one bit for each shared byte
    near[near] = np.bitwise_count(x[near]) <= MAX_BITS
    left, right = np.arange(len(a)), np.arange(len(b)) + len(a)
    label = np.concatenate([left, right])
    while True:
        low = np.minimum(left, np.where(near, right[None, :], len(label)).min(1, initial=len(label)))
        high = np.minimum(right, np.where(near, low[:, None], len(label)).min(0, initial=len(label)))
        if (low == left).all() and (high == right).all():
            break
        left, right = low, high
    fps, label = np.concatenate([a, b]), np.concatenate([left, right])
    out = pd.DataFrame({"a": fps, "b": fps[label]})
    return out[out["a"] != out["b"]].drop_duplicates()


def fingerprint_links(weights: DataFrame) -> DataFrame:
    """weights: distinct (fp, n). Edges (a, b) of a graph with the components of the links at MAX_BITS or fewer bits."""
    posted = weights.select("fp", "n", F.explode(_postings(F.col("fp"))).alias("list"))
    lists = posted.groupBy("list").agg(F.count(F.lit(1)).alias("rows"), F.max(F.struct("n", "fp"))["fp"].alias("pivot")).where("rows > 1")
    lists = stored(lists, "lists")  # so that both sides of the join are dealt out afresh, and Spark can split a long list
    met = stored(posted.drop("n").join(lists, "list"), "postings")
    short = met.where(F.col("rows") <= SHORT_LIST).select("list", "fp")
    pairs = short.join(short.withColumnRenamed("fp", "other"), "list").where(F.col("fp") < F.col("other"))
    edges = pairs.where(_near(F.col("fp"), F.col("other"))).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    long_lists = met.where(F.col("rows") > SHORT_LIST)
    star = long_lists.where((F.col("fp") != F.col("pivot")) & _near(F.col("fp"), F.col("pivot"))).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    open_rows = long_lists.where((F.col("fp") != F.col("pivot")) & ~_near(F.col("fp"), F.col("pivot"))).select("list", "fp", "rows")
    opened = stored(open_rows.groupBy("list").agg(F.count(F.lit(1)).alias("open_rows")), "opened")
    blocks = lambda rows: F.ceil(F.col(rows) / BLOCK).cast("int")
    cell = lambda rows: F.pmod(F.xxhash64("fp"), blocks(rows)).cast("int")
    every = lambda rows: F.explode(F.sequence(F.lit(0), blocks(rows) - 1))
    both = long_lists.select("list", "fp", "rows").join(opened, "list")
    left = open_rows.join(opened, "list").select("list", cell("open_rows").alias("i"), every("rows").alias("j"), "fp", F.lit(True).alias("open"))
    right = both.select("list", every("open_rows").alias("i"), cell("rows").alias("j"), "fp", F.lit(False).alias("open"))
    dense = left.unionByName(right).groupBy("list", "i", "j").applyInPandas(_forest, "a long, b long")
    return edges.unionByName(star).unionByName(dense).distinct()


def fingerprint_groups(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fp, n, least doc_id) of each fingerprint, and (fp, root) of those that are linked with others."""
    weights = stored(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "weights")
    return weights, stored(components(fingerprint_links(weights.select("fp", "n"))).withColumnRenamed("node", "fp"), "roots")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with the least (doc_id, text hash) of their component, null ids last; of repeated rows one. `docs` is
    read again, so it must give the same rows every time, as a stored table does.

    Rows that go and rows that are repeated are told by their ids and hashes. Texts are shuffled only where a bitmap of these
    doesn't clear them; the others stay where they are.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    fps = stored(fingerprints(docs), "fingerprints")
    roots = fingerprint_groups(fps)[1]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_hash")).alias("least")
    best = stored(fps.groupBy("fp").agg(least).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "best")
    of_root = stored(best.groupBy("root").agg(F.min("least").alias("least")), "least")  # a large component's rows can be split
    of_fp = stored(best.select("fp", "root").join(of_root, "root").select("fp", "least"), "least")  # and a frequent fingerprint's
    keys = fps.groupBy("doc_id", "text_hash").agg(F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n")).join(of_fp, "fp")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    marks = keys.select(F.col("doc_id").alias("__mark_id"), F.col("text_hash").alias("__mark_hash"), stays.alias("__stays"), "n").where("n > 1 or not __stays").drop("n")
    marks = stored(marks, "marks")
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__hash", text_hash(F.col("text"))).withColumn("__key", F.xxhash64("__id", "__hash"))
    met, clear = split_by_marks(keyed, "__key", marks.select(F.xxhash64("__mark_id", "__mark_hash").alias("key")))
    told = met.join(marks, F.col("__id").eqNullSafe(F.col("__mark_id")) & (F.col("__hash") == F.col("__mark_hash")), "left")
    told = stored(told.where("__stays is null or __stays"), "told")
    kept = clear.select(*names).unionByName(told.where("__stays is null").select(*names))
    return kept.unionByName(told.where("__stays").dropDuplicates(["__id", "__hash"]).select(*names))


def near_duplicates(docs: DataFrame, ngram: int = 3, seed: int = 42) -> DataFrame:
    """One row for each row of `docs`: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable), text_hash.

    Rows with equal fingerprints are linked, so are those without words (fingerprint zero) and repeated rows. A null text
    counts as empty; null ids get a component by their text and never name one unless all ids in it are null. An empty table
    gives an empty result. Columns other than doc_id and text aren't read.
    """
    fps = stored(fingerprints(docs, ngram, seed), "fingerprints")
    weights, roots = fingerprint_groups(fps)
    least = weights.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(least, "root").select("fp", "component_id")
    ids = stored(weights.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "ids")  # a frequent fingerprint's rows can be split
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")
