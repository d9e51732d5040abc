"""Accuracy against known sites, and descriptive statistics of occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kmers import overlap
from ..plans.state import stored
from .numbering import numbered, running_sum

#: Letters of one stretch of a sequence, swept by one task, and of a bin in which intervals are compared.
STRETCH = 1 << 16
BIN = 1 << 9


def _spans(rows: DataFrame, sequences: DataFrame, how: str = "inner") -> DataFrame:
    """Absolute starts: a negative rel_start counts from the sequence's end."""
    length = F.length("seq")
    start = F.when(F.col("rel_start") < 0, F.col("rel_start") + length).otherwise(F.col("rel_start"))
    return rows.join(sequences, "seq_id", how).select(*rows.columns, start.alias("start"), length.alias("seq_length"))


def raw_statistics(motifs: DataFrame, sites: DataFrame, sequences: DataFrame) -> DataFrame:
    """One row: nTP, nFP, nFN, nTN over bases, sTP and sFN over sites, sFP over motifs that meet no site.

    motifs: (motif_id, seq_id, rel_start, length); sites: (site_id, seq_id, rel_start, length). Bases outside the sequence don't
    count. Intervals are cut at every STRETCH letters, and each stretch of a sequence is swept once from left to right: an interval
    adds the bases beyond the furthest end so far, and meets one of the other kind if such a one began before its own end and ended
    behind its start. So work grows with the intervals, not with their letters, and no task gets more than one stretch.
    """
    spans = motifs.select(F.lit(True).alias("motif"), F.col("motif_id").cast("string").alias("id"), "seq_id", "rel_start", "length").unionByName(
        sites.select(F.lit(False).alias("motif"), F.col("site_id").cast("string").alias("id"), "seq_id", "rel_start", "length")
    )
    placed = _spans(spans, sequences, "left").select("motif", "id", "seq_id", F.greatest("start", F.lit(0)).alias("start"), F.when(F.col("seq_length").isNotNull(), F.least(F.col("start") + F.col("length"), "seq_length")).alias("end"))
    inside = placed.where("start < end").withColumn("stretch", F.explode(F.sequence((F.col("start") / STRETCH).cast("int"), ((F.col("end") - 1) / STRETCH).cast("int"))))
    inside = inside.select("motif", "id", "seq_id", "stretch", F.greatest("start", F.col("stretch") * STRETCH).alias("start"), F.least("end", (F.col("stretch") + 1) * STRETCH).alias("end"))
    # an interval is seen at its start, where it adds its bases, and at its last letter, where it asks for others
    events = inside.select("*", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(False).alias("asks")), F.struct((F.col("end") - 1).alias("at"), F.lit(True).alias("asks")))).alias("e")).select("*", "e.at", "e.asks")
    before = Window.partitionBy("seq_id", "stretch").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, -1)
    furthest = lambda motif: F.coalesce(F.max(F.when(~F.col("asks") & (F.col("motif") == motif), F.col("end"))).over(before), F.lit(-1))
    swept = events.withColumns({"m": furthest(True), "s": furthest(False)})
    new = lambda reach: F.when(~F.col("asks"), F.greatest(F.lit(0), F.col("end") - F.greatest("start", reach))).otherwise(0)
    other = F.when(F.col("motif"), F.col("s")).otherwise(F.col("m"))
    one = swept.select("motif", "id", (F.col("asks") & (other > F.col("start"))).alias("met"), F.when(F.col("motif"), new(F.col("m"))).otherwise(0).alias("m"), F.when(~F.col("motif"), new(F.col("s"))).otherwise(0).alias("s"), new(F.greatest("m", "s")).alias("u"))
    # intervals outside their sequences, or of unknown ones, are met by none
    outside = placed.where("start is null or end is null or start >= end").select("motif", "id", F.lit(False).alias("met"), *[F.lit(0).alias(c) for c in "msu"])
    by_id = one.unionByName(outside).groupBy("motif", "id").agg(F.max("met").alias("met"), *[F.sum(c).alias(c) for c in "msu"])
    count = lambda motif, met: F.count_if(F.col("id").isNotNull() & (F.col("motif") == motif) & (F.col("met") == met))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "msu"]
    n = by_id.agg(*sums, count(False, True).alias("sTP"), count(False, False).alias("sFN"), count(True, False).alias("sFP"))
    total = sequences.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("total"))
    row = n.join(total)  # single rows
    both = F.col("m") + F.col("s") - F.col("u")
    return row.select(both.alias("nTP"), (F.col("m") - both).alias("nFP"), (F.col("s") - both).alias("nFN"), (F.col("total") - F.col("u")).alias("nTN"), "sTP", "sFN", "sFP")


def _pieces(rows: DataFrame, sequences: DataFrame, *keys: str) -> DataFrame:
    """(keys, seq_id, bin, start, end): the parts of intervals inside their sequences, cut at every BIN letters."""
    placed = _spans(rows, sequences).select(*keys, "seq_id", F.greatest("start", F.lit(0)).alias("start"), F.least(F.col("start") + F.col("length"), "seq_length").alias("end")).where("start < end")
    cut = placed.withColumn("bin", F.explode(F.sequence((F.col("start") / BIN).cast("int"), ((F.col("end") - 1) / BIN).cast("int"))))
    return cut.select(*keys, "seq_id", "bin", F.greatest("start", F.col("bin") * BIN).alias("start"), F.least("end", (F.col("bin") + 1) * BIN).alias("end"))


def _joined_up(pieces: DataFrame, *keys: str) -> DataFrame:
    """Pieces that touch or overlap become one, so that those of a bin are disjoint. Equal pieces meet before they are shuffled."""
    lanes = Window.partitionBy(*keys, "seq_id", "bin").orderBy("start")
    longest = pieces.groupBy(*keys, "seq_id", "bin", "start").agg(F.max("end").alias("end"))
    before = F.max("end").over(lanes.rowsBetween(Window.unboundedPreceding, -1))
    islands = longest.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(lanes))
    return islands.groupBy(*keys, "seq_id", "bin", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _meeting(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of pieces of a and b that share a base, with their `overlap`: joined by bin, compared by their ends."""
    other = b.withColumnsRenamed({"start": "__start", "end": "__end"})
    both = overlap(F.col("start"), F.col("end") - F.col("start"), F.col("__start"), F.col("__end") - F.col("__start"))
    return a.join(other, ["seq_id", "bin"]).withColumn("overlap", both).where("overlap > 0").drop("__start", "__end")


def raw_statistics_by(motifs: DataFrame, sites: DataFrame, sequences: DataFrame) -> DataFrame:
    """The statistics of `raw_statistics` for each pattern against the same sites; motifs: (pattern, motif_id, seq_id, rel_start,
    length). Motifs that are empty, outside their sequences or of unknown ones meet no site, and their pattern has a row all the same.

    Intervals are cut into bins of BIN letters and joined by bin. Those of a pattern, and those of all sites, are joined up first, so a
    bin holds few of them, whatever the number of motifs; no base becomes a row.
    """
    motif_pieces, site_pieces = stored(_pieces(motifs, sequences, "pattern", "motif_id")), stored(_pieces(sites, sequences, "site_id"))
    found, known = stored(_joined_up(motif_pieces, "pattern")), stored(_joined_up(site_pieces))
    length = (F.col("end") - F.col("start")).cast("long")
    counts = [
        found.groupBy("pattern").agg(F.sum(length).alias("bases")),
        _meeting(found, known).groupBy("pattern").agg(F.sum("overlap").alias("nTP")),
        _meeting(site_pieces, found).select("pattern", "site_id").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("sTP")),
        _meeting(motif_pieces, known).select("pattern", "motif_id").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("met")),
    ]
    rows = motifs.groupBy("pattern").agg(F.count_distinct("motif_id").alias("motifs"))
    for one in counts:
        rows = rows.join(one, "pattern", "left")
    rows = rows.fillna(0, ["bases", "nTP", "sTP", "met"])
    totals = sequences.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("total")).join(known.agg(F.coalesce(F.sum(length), F.lit(0)).alias("site_bases"))).join(sites.agg(F.count_distinct("site_id").alias("n_sites")))  # single rows
    false_found, false_left = F.col("bases") - F.col("nTP"), F.col("site_bases") - F.col("nTP")
    return rows.join(F.broadcast(totals)).select(
        "pattern", "nTP", false_found.alias("nFP"), false_left.alias("nFN"), (F.col("total") - F.col("nTP") - false_found - false_left).alias("nTN"), "sTP", (F.col("n_sites") - F.col("sTP")).alias("sFN"),
        (F.col("motifs") - F.col("met")).alias("sFP"),
    )


def site_overlaps(motifs: DataFrame, sites: DataFrame, sequences: DataFrame) -> DataFrame:
    """(motif_id, site_id, overlap) of all pairs that share a base inside their sequence; the overlaps of their pieces are summed."""
    pairs = _meeting(_pieces(motifs, sequences, "motif_id"), _pieces(sites, sequences, "site_id"))
    return pairs.groupBy("motif_id", "site_id").agg(F.sum("overlap").alias("overlap"))


def one_per_sequence(scored: DataFrame) -> DataFrame:
    """scored: (seq_id, start, score, distance). One row: the means over sequences of the best score, the distance of its
    occurrence, the least distance, and the score of its occurrence. Only scores above 0 count as a best one; the first wins."""
    best = scored.where("score > 0").groupBy("seq_id").agg(F.max_by(F.struct("score", "distance"), F.struct("score", -F.col("start"))).alias("b"))
    near = scored.groupBy("seq_id").agg(F.min_by(F.struct("score", "distance"), F.struct("distance", "start")).alias("c"))
    return near.join(best, "seq_id", "left").agg(
        F.round(F.avg("b.score"), 6).alias("best_score"), F.round(F.avg("b.distance"), 6).alias("best_score_distance"), F.round(F.avg("c.distance"), 6).alias("least_distance"), F.round(F.avg("c.score"), 6).alias("least_distance_score"),
    )


def centrality(occurrences: DataFrame, bundles: DataFrame) -> DataFrame:
    """(delta, n): how many distinct occurrences have their middle delta letters before the summit, for every delta from -N to N,
    where N is the number of bundles."""
    middle = F.floor((2 * F.col("start") + F.col("size")) / 2)
    deltas = occurrences.select("seq_id", "start", "size").distinct().join(bundles.select("seq_id", "summit"), "seq_id").groupBy((F.col("summit") - middle).alias("delta")).agg(F.count(F.lit(1)).alias("n"))
    k = bundles.count()
    spine = bundles.sparkSession.range(-k, k + 1).withColumnRenamed("id", "delta")
    return spine.join(deltas, "delta", "left").select("delta", F.coalesce("n", F.lit(0)).alias("n"))


def start_histogram(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("seq_id", "start").agg(F.count(F.lit(1)).alias("n"))


def colours(occurrences: DataFrame, sequences: DataFrame, stretch: int, *keys: str) -> DataFrame:
    """(keys, pattern, colour): all sequences, one after another by seq_id, are cut into stretches of `stretch` letters, and a pattern has
    the number of the first one in which it begins. `keys` tell sets of patterns apart. Occurrences that begin outside their sequence
    colour nothing."""
    laid = running_sum(sequences.select("seq_id", F.length("seq").cast("long").alias("length")), [], F.col("length"), "seq_id", name="before")
    touched = occurrences.join(laid, "seq_id").where("start >= 0 and start < length")
    return touched.groupBy(*keys, "pattern").agg(F.floor(F.min(F.col("before") + F.col("start")) / stretch).alias("colour"))


def coloured_starts(occurrences: DataFrame, coloured: DataFrame, *keys: str) -> DataFrame:
    """(keys, colour, seq_id, start, n): for each colour and sequence, how often patterns of that colour begin at a position."""
    return occurrences.join(coloured, [*keys, "pattern"]).groupBy(*keys, "colour", "seq_id", "start").agg(F.count(F.lit(1)).alias("n"))


def similar(instances: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst) of different patterns of which dst's label is among src's instance texts. instances: (pattern, text); labels:
    (pattern, label)."""
    texts = instances.select(F.col("pattern").alias("src"), "text").distinct()
    return texts.join(labels.select(F.col("pattern").alias("dst"), F.col("label").alias("text")), "text").where("src <> dst").select("src", "dst").distinct()


def mutual(edges: DataFrame) -> DataFrame:
    """Edges that go both ways."""
    return edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")


def distance_matrix(members: DataFrame) -> DataFrame:
    """members: (group, text). (group, a, b, distance) of all pairs of a group's distinct texts; it is the result that is
    quadratic in a group's size."""
    a = members.select("group", F.col("text").alias("a")).distinct()
    return a.join(a.withColumnRenamed("a", "b"), "group").select("group", "a", "b", F.levenshtein("a", "b").alias("distance"))


def rank_entries(entries: DataFrame, *keys: str) -> DataFrame:
    """Rank from 0 by ascending score within keys; ties by id. Keys of any size are spread over range partitions."""
    return numbered(entries, list(keys), "score", "id", name="rank")
