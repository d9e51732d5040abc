"""The inverted index of a lexicon: which labels begin at a position of a sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def onsequence(occurrences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(seq_id, pos, label) of the lexicon's labels."""
    return occurrences.join(lexicon.select("label"), "label", "left_semi").select("seq_id", F.col("start").alias("pos"), "label")


def analysis(index: DataFrame, sequences: DataFrame) -> DataFrame:
    """(seq_id, words) for every sequence, those without any label too."""
    return sequences.select("seq_id").join(index.groupBy("seq_id").agg(F.count(F.lit(1)).alias("words")), "seq_id", "left").select("seq_id", F.coalesce("words", F.lit(0)).alias("words"))


def bitmaps(occurrences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Per sequence and bucket of positions, a bitmap of the positions that a lexicon label covers."""
    covered = occurrences.join(lexicon.select("label"), "label", "left_semi").select("seq_id", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).select("seq_id", F.col("pos").cast("long").alias("pos")).distinct()
    return covered.groupBy("seq_id", F.bitmap_bucket_number("pos").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bitmap"), F.count(F.lit(1)).alias("covered"))


#: Positions of one mask word.
WORD = 64


def masks(places: DataFrame, *keys: str) -> DataFrame:
    """(keys, seq_id, word, mask) of places (keys, seq_id, pos): bit pos % 64 of word pos / 64 is set; negative positions have none."""
    rows = places.where("pos >= 0").select(*keys, "seq_id", F.floor(F.col("pos") / WORD).alias("word"), F.expr(f"shiftleft(1L, cast(pos % {WORD} as int))").alias("bit"))
    return rows.groupBy(*keys, "seq_id", "word").agg(F.bit_or("bit").alias("mask"))


def label_masks(index: DataFrame) -> DataFrame:
    """(label, seq_id, word, mask): where each label of an index (seq_id, pos, label) begins."""
    return masks(index, "label")


def next_masks(patterns: DataFrame, overlap: int, gap: int) -> DataFrame:
    """(pattern, seq_id, word, mask): where a word may begin that follows an occurrence (pattern, seq_id, start, size), from `overlap`
    letters before its end to `gap` behind it.

    The ends of a pattern are one mask; the band is the union of that mask moved by every offset, with the bits that leave a word on
    either side carried to its neighbour. So a word makes at most three rows, however wide the band and however many its ends.
    """
    if overlap < 0 or gap < 0 or max(overlap, gap) >= WORD:
        raise ValueError(f"overlap and gap are from 0 to {WORD - 1}")
    ends = masks(patterns.select("pattern", "seq_id", (F.col("start") + F.col("size")).alias("pos")), "pattern")
    union = lambda parts: " | ".join(parts) or "0L"
    own = union([f"shiftleft(mask, {s})" for s in range(gap + 1)] + [f"shiftrightunsigned(mask, {s})" for s in range(1, overlap + 1)])
    up = union([f"shiftrightunsigned(mask, {WORD - s})" for s in range(1, gap + 1)])
    down = union([f"shiftleft(mask, {WORD - s})" for s in range(1, overlap + 1)])
    moved = F.expr(f"inline(array(struct(word as word, {own} as mask), struct(word + 1 as word, {up} as mask), struct(word - 1 as word, {down} as mask)))")
    rows = ends.select("pattern", "seq_id", moved).where("mask <> 0 and word >= 0")
    return rows.groupBy("pattern", "seq_id", "word").agg(F.bit_or("mask").alias("mask"))


def positions(masked: DataFrame) -> DataFrame:
    """The positions (column pos) of masks, one row for each set bit."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit("mask", b) == 1)
    rest = [c for c in masked.columns if c not in ("word", "mask")]
    return masked.select(*rest, "word", F.explode(bits).alias("bit")).select(*rest, (F.col("word") * WORD + F.col("bit")).alias("pos"))


def candidates(patterns: DataFrame, index: DataFrame, overlap: int, gap: int) -> DataFrame:
    """(pattern, seq_id, word, mask): the positions in the band behind a pattern where some label begins."""
    starts = masks(index).withColumnRenamed("mask", "__starts")
    both = next_masks(patterns, overlap, gap).join(starts, ["seq_id", "word"]).withColumn("mask", F.col("mask").bitwiseAND(F.col("__starts")))
    return both.where("mask <> 0").select("pattern", "seq_id", "word", "mask")


def pair_supports(patterns: DataFrame, index: DataFrame, overlap: int, gap: int) -> DataFrame:
    """(pattern, label, q): in how many sequences the label begins in the band behind the pattern; a bound for the support of a chain,
    from words of masks instead of pairs of places."""
    met = next_masks(patterns, overlap, gap).withColumnRenamed("mask", "band").join(label_masks(index), ["seq_id", "word"]).where(F.col("band").bitwiseAND(F.col("mask")) != 0)
    return met.select("pattern", "label", "seq_id").distinct().groupBy("pattern", "label").agg(F.count(F.lit(1)).alias("q"))
