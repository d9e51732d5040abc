"""Position weight matrices and the three scores of patterns.

A matrix is a table (pos, base, fwd, rev); counts are (pos, base, count). Occurrences are (pattern, seq_id, start, size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kmers import complement, log_odds
from .windows import piece_of


def matrix(counts: DataFrame, pseudocount: float = 1.0) -> DataFrame:
    """The log-odds matrix and its reverse complement. The denominator of a reverse entry is the column sum at the same position of
    the forward matrix, as in the original method."""
    total = Window.partitionBy("pos")
    rows = counts.withColumn("total", F.sum("count").over(total))
    last = counts.agg(F.max("pos").alias("last"))
    turned = rows.join(F.broadcast(last)).select((F.col("last") - F.col("pos")).alias("pos"), complement(F.col("base")).alias("base"), F.col("count").alias("rev_count"))
    return rows.join(turned, ["pos", "base"]).select("pos", "base", log_odds(F.col("count"), F.col("total"), pseudocount).alias("fwd"), log_odds(F.col("rev_count"), F.col("total"), pseudocount).alias("rev"))


def matrix_scores(strings: DataFrame, pwm: DataFrame, partial: bool = True) -> DataFrame:
    """Best alignment of a matrix with each distinct string: (text, fwd, fwd_end, rev, rev_end).

    All alignments with at least one common position count, or with partial=False only those in which the whole matrix lies within
    the string. Of equal scores the last alignment wins; the end is where the matrix' last covered letter ends.
    """
    m = pwm.agg((F.max("pos") + 1).cast("int").alias("m"))
    n = F.length("text")
    offsets = F.sequence(F.lit(1), n + F.col("m") - 1) if partial else F.sequence(F.col("m"), n)
    rows = strings.select("text").distinct().where("length(text) > 0").join(F.broadcast(m))
    if not partial:
        rows = rows.where("length(text) >= m")
    rows = rows.select("text", "m", F.explode(offsets).alias("i"))
    first, skip = F.greatest(F.lit(0), F.col("i") - F.col("m")), F.greatest(F.lit(0), F.col("m") - F.col("i"))
    rows = rows.select("text", "i", F.explode(F.sequence(F.lit(0), F.least(n - first, F.col("m") - skip) - 1)).alias("j"), first.alias("first"), skip.alias("skip"))
    cells = rows.select("text", "i", F.least(F.col("i"), n).alias("end"), F.substring("text", F.col("first") + F.col("j") + 1, F.lit(1)).alias("base"), (F.col("skip") + F.col("j")).alias("pos"))
    sums = cells.join(F.broadcast(pwm), ["pos", "base"]).groupBy("text", "i", "end").agg(F.round(F.sum("fwd"), 9).alias("fwd"), F.round(F.sum("rev"), 9).alias("rev"))
    best = sums.groupBy("text").agg(F.max(F.struct("fwd", "i", "end")).alias("f"), F.max(F.struct("rev", "i", "end")).alias("r"))
    return best.select("text", F.col("f.fwd").alias("fwd"), F.col("f.end").alias("fwd_end"), F.col("r.rev").alias("rev"), F.col("r.end").alias("rev_end"))


def mean_matrix_score(strings: DataFrame, pwm: DataFrame) -> DataFrame:
    """One row (score): the mean over strings (text), repeated ones included, of the better strand's best score. Empty strings don't
    count."""
    times = strings.groupBy("text").agg(F.count(F.lit(1)).alias("times"))
    scored = times.join(matrix_scores(times, pwm), "text")
    return scored.agg((F.sum(F.greatest("fwd", "rev") * F.col("times")) / F.sum("times")).alias("score"))


def site_centrality(sites: DataFrame, bundles: DataFrame) -> DataFrame:
    """One row (summit): the mean distance of parsed sites (seq_id, start, end), counted from 1 with the end itself, from the summits."""
    placed = sites.select(F.lit("sites").alias("pattern"), "seq_id", (F.col("start") - 1).alias("start"), (F.col("end") - F.col("start") + 1).alias("size"))
    return summit_distance(placed, bundles).select("summit")


def instances(occurrences: DataFrame, sequences: DataFrame) -> DataFrame:
    """Occurrences with their letters, clipped at the sequence's end: column text."""
    return occurrences.join(sequences, "seq_id").withColumn("text", piece_of(F.col("seq"), F.col("start"), F.col("size"))).drop("seq")


def ssmart(occurrences: DataFrame, bundles: DataFrame) -> DataFrame:
    """(pattern, ssmart): the mean of maxlog2fc over the sequences of a pattern less the mean over the others; the latter is 0
    where their sum is. Higher is better."""
    inside = occurrences.select("pattern", "seq_id").distinct().join(bundles.select("seq_id", "maxlog2fc"), "seq_id").groupBy("pattern").agg(F.sum("maxlog2fc").alias("inside"), F.count(F.lit(1)).alias("card"))
    totals = bundles.agg(F.sum("maxlog2fc").alias("total"), F.count(F.lit(1)).alias("sequences"))
    rest = F.round(F.col("total") - F.col("inside"), 6)
    return inside.join(F.broadcast(totals)).select("pattern", (F.col("inside") / F.col("card") - F.when((rest == 0) | (F.col("sequences") == F.col("card")), 0.0).otherwise(rest / (F.col("sequences") - F.col("card")))).alias("ssmart"))


def summit_distance(occurrences: DataFrame, bundles: DataFrame) -> DataFrame:
    """(pattern, summit): the mean over occurrences of the distance of their middle from the summit. Lower is better."""
    middle = F.floor((2 * F.col("start") + F.col("size")) / 2)
    return occurrences.join(bundles.select("seq_id", F.col("summit").alias("at")), "seq_id").groupBy("pattern").agg(F.avg(F.abs(F.col("at") - middle)).alias("summit"))


def matrix_score(occurrences: DataFrame, sequences: DataFrame, pwm: DataFrame, clip: str = "native") -> DataFrame:
    """(pattern, jaspar): the mean over occurrences of the better strand's best score. With clip 'native' an occurrence that the
    sequence's end cuts off has an empty alignment of score 0 too. Texts are counted before they are scored."""
    found = instances(occurrences, sequences).groupBy("pattern", "text", (F.length("text") < F.col("size")).alias("cut")).agg(F.count(F.lit(1)).alias("times"))
    scored = found.join(matrix_scores(found, pwm), "text", "left").withColumn("best", F.greatest("fwd", "rev"))
    if clip == "native":
        scored = scored.withColumn("best", F.when(F.col("cut"), F.greatest("best", F.lit(0.0))).otherwise(F.col("best")))
    return scored.groupBy("pattern").agg((F.sum(F.col("best") * F.col("times")) / F.sum("times")).alias("jaspar"))


#: The matrices of three data sets.
MATRICES = {
    "ENCODE_HAIB_GM12878_SRF_peak": "MA0083.2",
    "ENCODE_Stanford_HepG2_CEBPB_peak": "MA0466.1",
    "ENCODE_Yale_HepG2_SREBF1_peak": "MA0829.2",
}


def matrix_name(dataset: Column) -> Column:
    """The matrix of a data set, whose name is the last part of its path; null for others."""
    return F.create_map(*[F.lit(x) for pair in MATRICES.items() for x in pair])[F.element_at(F.split(dataset, "/"), -1)]
