"""Chaining: growing patterns by lexicon words that begin near their ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runs import Stop
from ..plans.state import stored
from .observe import support


def chain_step(patterns: DataFrame, index: DataFrame, sequences: DataFrame, overlap: int, gap: int, q: int, end_bound: str = "native", dedup: bool = False) -> DataFrame:
    """One generation: (pattern, word, label, seq_id, start, size) of every pair of a pattern and a word with support q.

    patterns: (pattern, label, seq_id, start, size); index: (seq_id, pos, label). A word may begin from `overlap` letters before a
    pattern's end to `gap` after it, behind the pattern's start and inside the sequence, and must end behind the pattern's end;
    with end_bound 'native' it must also end before the sequence's last letter. Labels are joined without merging the overlap.
    The band of offsets is exploded, so that the join is an equi-join on sequence and position. The pairs' occurrences are written
    once; their supports are counted from that table, and it is read again for those that reach q.
    """
    offsets = F.explode(F.sequence(F.lit(-overlap), F.lit(gap)))
    ends = patterns.join(sequences.select("seq_id", F.length("seq").alias("length")), "seq_id").select("pattern", F.col("label").alias("parent"), "seq_id", "start", "size", "length", offsets.alias("shift"))
    ends = ends.withColumn("pos", F.col("start") + F.col("size") + F.col("shift")).where("pos < length and pos > start")
    met = ends.join(index.select("seq_id", "pos", F.col("label").alias("word")), ["seq_id", "pos"]).withColumn("grown", F.col("size") + F.length("word") + F.col("shift"))
    met = met.where("grown > size")
    if end_bound == "native":
        met = met.where("start + grown < length")
    elif end_bound != "python":
        raise ValueError("end_bound is native or python")
    out = met.select("pattern", "word", F.concat("parent", "word").alias("label"), "seq_id", "start", F.col("grown").alias("size"))
    out = stored(out.distinct() if dedup else out)
    kept = support(out, "pattern", "word").where(F.col("q") >= q).select("pattern", "word")
    return out.join(kept, ["pattern", "word"])


def grow(
    patterns: DataFrame, index: DataFrame, sequences: DataFrame, overlap: int, gap: int, q: int, generations: int, prune: Callable[[DataFrame, int], DataFrame] | None = None, seconds: float | None = None,
    stop_file: str | None = None, keep: Callable[[int, DataFrame], DataFrame] | None = None, grown: list[DataFrame] | None = None, **options,
) -> DataFrame:
    """All generations up to `generations`, with a column generation; stops at an empty one.

    `prune` gets a generation's occurrences and returns those to grow further. All patterns of a generation are scored together,
    so the result doesn't depend on an order of work. Each generation is written to cut its lineage: by `keep`, which gets its number and
    occurrences and returns them as written, or into the shared folder. `grown`: generations that are there already, from the first on.

    After `seconds`, or once `stop_file` exists, the jobs of the generation in work are ended; those finished by then are the result.
    """
    keep = keep or (lambda _, rows: stored(rows))
    found = list(grown or [])
    first = patterns.select("pattern", "label", "seq_id", "start", "size")
    frontier = found[-1] if found else first
    with Stop(patterns.sparkSession, seconds, stop_file) as stop:
        for g in range(len(found) + 1, generations + 1):
            if stop.fired or (found and found[-1].isEmpty()):
                break
            front = prune(frontier, g) if prune else frontier
            step = chain_step(front, index, sequences, overlap, gap, q, **options)
            frontier = keep(g, step.select(F.concat_ws("|", "pattern", "word").alias("pattern"), "label", "seq_id", "start", "size"))
            found.append(frontier)
    out = patterns.withColumn("generation", F.lit(0))
    for g, rows in enumerate(found, 1):
        out = out.unionByName(rows.withColumn("generation", F.lit(g)), allowMissingColumns=True)
    return out
