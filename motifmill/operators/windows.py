"""Sliding windows over sequences (seq_id, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.state import stored

#: Windows start in pieces of this length, since finding a position of a string takes time that grows with the position.
PIECE = 256


def by_use_of_id(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences whose id no other has, and the rest (of repeated ids, or without one). Most tables have none of the latter, and theirs is
    an empty frame then."""
    again = stored(sequences.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or seq_id is null").select("seq_id"))
    if again.isEmpty():
        return sequences, sequences.where("false")
    same = sequences["seq_id"].eqNullSafe(again["seq_id"])
    return sequences.join(again, same, "left_anti"), sequences.join(again, same, "left_semi")


def frames(sequences: DataFrame, k: int, include_last: bool = False, at_least_one: bool = False) -> DataFrame:
    """(seq_id, start, frame) of every window of k letters. By default the last window is left out, as in the original
    method: max(0, length - k) windows; `at_least_one` gives a sequence of exactly k letters its only window."""
    length = F.length("seq")
    count = length - k + (1 if include_last else 0)
    if at_least_one:
        count = F.when(length == k, 1).otherwise(count)
    pieces = sequences.select("seq_id", "seq", count.alias("n")).where("n > 0").select("seq_id", "n", "seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(PIECE))).alias("at"))
    pieces = pieces.select("seq_id", "n", "at", F.substring("seq", F.col("at") + 1, F.lit(PIECE + k - 1)).alias("piece"))
    inside = F.explode(F.sequence(F.lit(0), F.least(F.lit(PIECE), F.col("n") - F.col("at")) - 1))
    return pieces.select("seq_id", "at", "piece", inside.alias("i")).select("seq_id", (F.col("at") + F.col("i")).alias("start"), F.substring("piece", F.col("i") + 1, F.lit(k)).alias("frame"))


def places(sequences: DataFrame, words: list[str]) -> DataFrame:
    """(word, seq_id, start, seq_length) of every window that is one of `words`, all of one length; a piece's windows are looked
    through before any of them becomes a row."""
    k = len(words[0])
    pieces = sequences.select("seq_id", "seq", F.length("seq").alias("seq_length")).where(F.col("seq_length") > k).select("seq_id", "seq", "seq_length", F.explode(F.sequence(F.lit(0), F.col("seq_length") - k - 1, F.lit(PIECE))).alias("at"))
    pieces = pieces.select("seq_id", "seq_length", "at", F.substring("seq", F.col("at") + 1, F.lit(PIECE + k - 1)).alias("piece"))
    inside = F.sequence(F.lit(0), F.least(F.lit(PIECE), F.col("seq_length") - k - F.col("at")) - 1)
    word = lambda i: F.substring(F.col("piece"), i + 1, F.lit(k))
    found = pieces.select("seq_id", "seq_length", "at", "piece", F.explode(F.filter(inside, lambda i: word(i).isin(words))).alias("i"))
    return found.select(word(F.col("i")).alias("word"), "seq_id", (F.col("at") + F.col("i")).alias("start"), "seq_length")


def multilayer_frames(sequences: DataFrame, layers: list[tuple[int, int]]) -> DataFrame:
    """(seq_id, start, frame, k, d): the windows of several layers of (length, distance), each for itself."""
    out = None
    for k, d in layers:
        layer = frames(sequences, k, at_least_one=True).withColumns({"k": F.lit(k), "d": F.lit(d)})
        out = layer if out is None else out.unionByName(layer)
    return out


def piece_of(seq: Column, start: Column, size: Column) -> Column:
    """The letters from `start`, counted from 0, clipped at the end."""
    return F.substring(seq, start + 1, size)


def brief(sequences: DataFrame, bundles: DataFrame, most: int = 200, longest: int = 400) -> DataFrame:
    """The `most` sequences of the largest maxlog2fc, cut to `longest` letters around their summits.

    Result: new_id (rank from 0), seq_id, seq, summit (moved with the cut), maxlog2fc. A cut that would begin before the sequence
    moves right; one that ends behind it is clipped.
    """
    joined = sequences.join(bundles, "seq_id").orderBy(F.desc("maxlog2fc"), "seq_id").limit(most)
    from pyspark.sql import Window

    ranked = joined.withColumn("new_id", F.row_number().over(Window.orderBy(F.desc("maxlog2fc"), "seq_id")) - 1)  # at most `most` rows
    first = F.ceil((2 * F.col("summit") - longest) / 2)
    start = F.when(F.length("seq") > longest, F.greatest(F.lit(0), first)).otherwise(0)
    return ranked.select("new_id", "seq_id", F.substring("seq", (start + 1).cast("int"), F.lit(longest)).alias("seq"), (F.col("summit") - start).cast("long").alias("summit"), "maxlog2fc")
