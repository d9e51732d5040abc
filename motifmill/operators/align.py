"""Alignments: column statistics, consensus score, segments, and a small centre-star aligner."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kmers import best_segment, complement, log_odds


def columns(aligned: DataFrame) -> DataFrame:
    """aligned: (group, id, text) with '-' for gaps. (group, pos, letter, n)."""
    letters = aligned.select("group", F.posexplode(F.array_remove(F.split("text", ""), "")).alias("pos", "letter"))
    return letters.groupBy("group", "pos", "letter").agg(F.count(F.lit(1)).alias("n"))


def consensus(aligned: DataFrame) -> DataFrame:
    """(group, consensus): the mean over columns of the most frequent letter's share; a column in which the gaps are as many counts 0."""
    by_column = columns(aligned).groupBy("group", "pos").agg(
        F.coalesce(F.max(F.when(F.col("letter") != "-", F.col("n"))), F.lit(0)).alias("top"), F.coalesce(F.max(F.when(F.col("letter") == "-", F.col("n"))), F.lit(0)).alias("gaps"), F.sum("n").alias("rows"),
    )
    share = F.when(F.greatest("top", "gaps") == F.col("gaps"), 0.0).otherwise(F.col("top") / F.col("rows"))
    return by_column.groupBy("group").agg(F.avg(share).alias("consensus"))


def segment(aligned: DataFrame) -> DataFrame:
    """(group, best, first, last): the run of columns in which the letters' counts exceed the mean count the most."""
    counts = columns(aligned).groupBy("group", "pos").agg(F.sum(F.when(F.col("letter") != "-", F.col("n")).otherwise(0)).alias("n"))
    excess = F.round(F.col("n") - F.avg("n").over(Window.partitionBy("group")), 6)
    rows = counts.withColumn("excess", excess).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("pos", "excess"))).alias("c"))  # one row an alignment column
    return rows.select("group", best_segment(F.col("c.excess")).alias("s")).select("group", "s.*")


def segment_matrix(aligned: DataFrame) -> DataFrame:
    """(group, pos, base, fwd) of the best segment's log odds, gaps left out."""
    at = segment(aligned).select("group", "first", "last")
    counted = columns(aligned).where("letter <> '-'").join(at, "group").where("pos between first and last")
    spine = at.select("group", F.explode(F.sequence("first", "last")).alias("pos"), "first").select("group", "pos", "first", F.explode(F.array(*map(F.lit, "ACGT"))).alias("base"))
    rows = spine.join(counted.select("group", "pos", F.col("letter").alias("base"), "n"), ["group", "pos", "base"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("group", (F.col("pos") - F.col("first")).alias("pos"), "base", log_odds(F.col("n"), F.sum("n").over(Window.partitionBy("group", "pos"))).alias("fwd"))


def without_negatives(m: DataFrame) -> DataFrame:
    """A matrix (group, pos, base, fwd) whose negative values are 0, as a logo shows it."""
    return m.withColumn("fwd", F.greatest("fwd", F.lit(0.0)))


def reverse_complement(m: DataFrame) -> DataFrame:
    """(group, pos, base, fwd) of the other strand of a segment's matrix."""
    last = m.groupBy("group").agg(F.max("pos").alias("last"))
    return m.join(last, "group").select("group", (F.col("last") - F.col("pos")).alias("pos"), complement(F.col("base")).alias("base"), "fwd")


def _pairwise(a: str, b: str) -> tuple[str, str]:
    """Global alignment at unit costs."""
    cost = [list(range(len(b) + 1))] + [[i] + [0] * len(b) for i in range(1, len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (x != y), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((a[i], "-"))
        else:
            j -= 1
            out.append(("-", b[j]))
    return "".join(x for x, _ in out[::-1]), "".join(y for _, y in out[::-1])


def _centre_star(texts: list[str]) -> list[str]:
    """Aligns every text with the one of the least total length difference and spreads the centre's gaps to all."""
    centre = min(texts, key=lambda t: (sum(abs(len(t) - len(o)) for o in texts), t))
    pairs = [_pairwise(centre, t) for t in texts]
    before = [0] * (len(centre) + 1)  # gaps in front of each letter of the centre, and at its end
    for c, _ in pairs:
        at = run = 0
        for x in c:
            if x == "-":
                run += 1
            else:
                before[at], run, at = max(before[at], run), 0, at + 1
        before[at] = max(before[at], run)
    out = []
    for c, t in pairs:
        row, at, run = [], 0, []
        for x, y in zip(c, t, strict=True):
            if x == "-":
                run.append(y)
            else:
                row += run + ["-"] * (before[at] - len(run)) + [y]
                at, run = at + 1, []
        out.append("".join(row + run + ["-"] * (before[at] - len(run))))
    return out


def align(members: DataFrame, aligner=_centre_star) -> DataFrame:
    """members: (group, id, text). (group, id, text) aligned; `aligner` takes and gives a list of texts. A group, the instances of one
    pattern, is aligned by one task; empty texts become gaps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pdf.assign(text=aligner(list(pdf["text"])))

    return members.select("group", F.col("id").cast("long").alias("id"), "text").groupBy("group").applyInPandas(run, f"group {members.schema['group'].dataType.simpleString()}, id long, text string")
