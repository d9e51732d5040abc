"""Observation of approximate k-mers in sequences, and lexicons by quorum.

Occurrences are normalised rows (label, seq_id, start, size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.state import stored
from .neighbourhood import Neighbourhood, neighbourhood
from .numbering import numbered
from .windows import by_use_of_id, frames


#: Ids are numbered anew for bitmaps where less than one in so many is used.
SPARSE = 64


def observe(sequences: DataFrame, k: int, d: int = 0, span: tuple[int, int] | None = None, known: Neighbourhood | None = None, **window) -> DataFrame:
    """Every window as an occurrence of itself and of all words within distance d (of the lengths in `span`, k by default).

    A neighbour's occurrence begins where the window does and has the neighbour's length, so it may go beyond the sequence.
    The distinct windows, at most 4^k, are expanded once and joined with the windows' places; `known`, a stored neighbourhood, takes the
    place of their expansion and is read by bucket.
    """
    places = frames(sequences, k, **window)
    own = places.select(F.col("frame").alias("label"), "seq_id", "start", F.lit(k).alias("size"))
    if d == 0:
        return own
    first, last = span or (k, k)
    if known is None:
        near = neighbourhood(places.select(F.col("frame").alias("kmer")).distinct(), first, last, d)
    else:
        near = known.near(k, d, first, last)
    others = places.join(near, places["frame"] == near["kmer"]).select(F.col("neighbour").alias("label"), "seq_id", "start", F.length("neighbour").alias("size"))
    return own.unionByName(others)


def observe_support(sequences: DataFrame, k: int, d: int, span: tuple[int, int] | None = None) -> DataFrame:
    """(label, q, n) as `support(observe(...))` gives them, without making the occurrences.

    The sequences of each distinct window, at most 4^k, are kept as bitmaps over their ids; a label's support is the number of bits in
    the union of its neighbours' bitmaps. Ids that don't lie close, such as hashes, are numbered first, so that bitmaps stay full.
    """
    seqs, (rows, least, most) = F.col("seq_id").cast("long"), sequences.agg(F.count("seq_id"), F.min("seq_id"), F.max("seq_id")).first()
    if rows and most - least > SPARSE * rows:
        sequences = numbered(sequences, [], "seq_id", name="__dense").withColumn("seq_id", F.col("__dense")).drop("__dense")
    counted = frames(sequences, k).groupBy("frame", "seq_id").agg(F.count(F.lit(1)).alias("n"))
    windows = counted.groupBy("frame", F.bitmap_bucket_number(seqs).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(seqs)).alias("bits"), F.sum("n").alias("n"))
    first, last = span or (k, k)
    distinct = windows.select(F.col("frame").alias("kmer")).distinct()
    near = neighbourhood(distinct, first, last, d).select("kmer", F.col("neighbour").alias("label"))
    near = near.unionByName(distinct.select("kmer", F.col("kmer").alias("label")))
    labels = windows.join(near, windows["frame"] == near["kmer"]).groupBy("label", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("n").alias("n"))
    return labels.groupBy("label").agg(F.sum(F.bitmap_count("bits")).alias("q"), F.sum("n").cast("long").alias("n"))


def observe_support_by_start(sequences: DataFrame, k: int, d: int, span: tuple[int, int] | None = None, known: Neighbourhood | None = None) -> DataFrame:
    """(label, start, q, n) as `support(observe(...), "label", "start")` gives them, without making the occurrences.

    A sequence has one window at a place, so where ids aren't repeated the windows alike at a place are counted, and their counts are
    added up for each neighbour: it is found at most once at a place of a sequence. Other sequences are observed as usual.
    """
    once, again = by_use_of_id(sequences)
    counted = stored(frames(once, k).groupBy("frame", "start").agg(F.count(F.lit(1)).alias("n")))
    first, last = span or (k, k)
    near = known.near(k, d, first, last) if known else neighbourhood(counted.select(F.col("frame").alias("kmer")).distinct(), first, last, d)
    others = counted.join(F.broadcast(near), counted["frame"] == near["kmer"])  # the neighbours of at most 4^k windows
    found = counted.select(F.col("frame").alias("label"), "start", F.col("n").alias("q"), "n").unionByName(others.select(F.col("neighbour").alias("label"), "start", F.col("n").alias("q"), "n"))
    every = found.unionByName(support(observe(again, k, d, span, known), "label", "start").select("label", "start", "q", "n"))
    return every.groupBy("label", "start").agg(F.sum("q").alias("q"), F.sum("n").alias("n"))


def distinct_occurrences(occurrences: DataFrame) -> DataFrame:
    return occurrences.distinct()


def support(occurrences: DataFrame, *keys: str) -> DataFrame:
    """q: the number of distinct sequences of each label; n: its occurrences. Counts by sequence first, so that one label's
    many occurrences meet as one row a sequence and task."""
    keys = keys or ("label",)
    return occurrences.groupBy(*keys, "seq_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.count(F.lit(1)).alias("q"), F.sum("n").alias("n"))


def lexicon(supports: DataFrame, q: int | Column, exact: bool = False) -> DataFrame:
    """Labels of a support of q or more, or of exactly q."""
    return supports.where(F.col("q") == q if exact else F.col("q") >= q)


def max_support(supports: DataFrame) -> DataFrame:
    return supports.agg(F.max("q").alias("q"))


def filled_lexicon(supports: DataFrame, size: int, q: int | None = None) -> DataFrame:
    """The labels of support q (by default the largest) or more; while these are fewer than `size`, the next lower supports
    are added whole, down to 1."""
    by_q = supports.groupBy("q").agg(F.count(F.lit(1)).alias("labels"))
    start = by_q.agg(F.max("q").alias("top")) if q is None else by_q.agg(F.lit(q).alias("top"))
    reach = by_q.withColumn("reached", F.sum("labels").over(Window.orderBy(F.desc("q"))))  # at most one row a sequence count
    cut = reach.join(F.broadcast(start)).where("q <= top and reached >= %d" % size).agg(F.max("q").alias("cut"))
    least = cut.join(F.broadcast(start)).select(F.least("top", F.coalesce("cut", F.lit(1))).alias("least"))
    return supports.join(F.broadcast(least)).where("q >= least").drop("least")


def trie_nodes(labels: DataFrame) -> DataFrame:
    """How many nodes the prefix tree of the labels has, its root included."""
    prefixes = labels.select(F.explode(F.sequence(F.lit(1), F.length("label"))).alias("i"), "label").select(F.substring("label", F.lit(1), F.col("i")).alias("prefix"))
    return prefixes.agg((F.count_distinct("prefix") + 1).alias("nodes"))
