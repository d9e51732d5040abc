"""Readers of the text formats that motif data come in. All give DataFrames with explicit ids, in file order.

A text file is split like any other: its splits are read by tasks of their own, and a line's number is its place in its split after the
lines of the splits before. Numbers of records are sums over lines, made in the same way, so no file has a task of its own.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import _summed, numbered
from ..plans.runs import Folder
from ..plans.state import stored


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line) of every line; the empty one after a last line break doesn't count. `block` is where the line's split
    begins, `at` the line's number in its file.

    The lines are stored as they are split, since another scan might split the files otherwise.
    """
    meta = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    read = spark.read.option("lineSep", "\n").text(path).select(*meta, F.regexp_replace("value", r"\r\z", "").alias("line"))
    laid = stored(read.withColumn("__id", F.monotonically_increasing_id()))
    splits = laid.groupBy(F.col("file").alias("__file"), F.col("block").alias("__block")).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    splits = stored(splits.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))))
    placed = laid.join(splits, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    return placed.select("file", "block", (F.col("__id") - F.col("__first") + F.col("__before")).alias("at"), "line")


def so_far(rows: DataFrame, flag: Column, name: str, own: bool = True) -> DataFrame:
    """`rows` of `lines` with `name`: how many lines of their file up to them (without them, unless `own`) have `flag`."""
    counted = _summed(stored(rows.withColumn("__value", flag.cast("long"))), "block", "at", [F.col("file")], name)
    return (counted.withColumn(name, F.col(name) + F.col("__value")) if own else counted).drop("__value")


def allowed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of the files whose name, without its folder, is in `names` (name)."""
    wanted = names.select(F.col("name").alias("__name")).distinct()
    return rows.join(wanted, F.element_at(F.split("file", "/"), -1) == wanted["__name"], "left_semi")


def fasta(spark: SparkSession, path: str, records: bool = False, names: bool = False) -> DataFrame:
    """(file, seq_id, seq). By default every line that isn't a header is a sequence; `records` joins the lines of a record. With `names`
    also `name`: the record's header without its mark, null before the first."""
    head = F.col("line").startswith(">")
    rows = so_far(lines(spark, path), head, "record")
    body = rows.where(~head)
    if records:
        body = body.groupBy("file", "record").agg(F.min("block").alias("block"), F.min("at").alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "").alias("line"))
    out = so_far(body, F.lit(True), "seq_id", own=False)
    if names:
        found = rows.where(head).select("file", "record", F.trim(F.substring("line", 2, 1 << 30)).alias("name"))
        return out.join(found, ["file", "record"], "left").select("file", "seq_id", "name", F.col("line").alias("seq"))
    return out.select("file", "seq_id", F.col("line").alias("seq"))


def _keyed(rows: DataFrame, *keys: str) -> DataFrame:
    """The `name,value` lines of records as the columns of a bundle."""
    pair = F.split("line", ",", 2)
    value = lambda name: F.max_by(F.when(pair[0] == name, F.trim(pair[1])), F.when(pair[0] == name, F.col("at")))
    return rows.groupBy(*keys).agg(value("FDR").cast("double").alias("fdr"), value("maxlog2FC").cast("double").alias("maxlog2fc"), value("summit").cast("int").alias("summit"))


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq_id, rank, fdr, maxlog2fc, summit): records of a `> id=rank` line and `name,value` lines."""
    rows = so_far(lines(spark, path), F.col("line").startswith(">"), "record")
    rank = rows.where(F.col("line").startswith(">")).select("file", "record", F.regexp_extract("line", r"=\s*(\d+)", 1).cast("int").alias("rank"))
    values = _keyed(rows, "file", "record")
    return rank.join(values, ["file", "record"], "left").select("file", (F.col("record") - 1).cast("int").alias("seq_id"), "rank", "fdr", "maxlog2fc", "summit")


def peak_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq_id, rank, seq, fdr, maxlog2fc, summit) of a combined file: `> id=rank`, the sequence, `> scores`, values.

    `by_rank` settles the order: the first record of a rank wins, ranks outside 0 to n - 1 go, ids close the holes."""
    rows = so_far(lines(spark, path), F.col("line").rlike(r"^>\s*id="), "record").where("record > 0")
    rows = rows.withColumn("part", F.sum(F.col("line").startswith(">").cast("int")).over(Window.partitionBy("file", "record").orderBy("at")))
    head = rows.where(F.col("line").rlike(r"^>\s*id=")).select("file", "record", F.regexp_extract("line", r"=\s*(\d+)", 1).cast("int").alias("rank"))
    seq = rows.where("part = 1").where(~F.col("line").startswith(">")).groupBy("file", "record").agg(F.min_by("line", "at").alias("seq"))
    return by_rank(head.join(seq, ["file", "record"]).join(_keyed(rows.where("part > 1"), "file", "record"), ["file", "record"], "left"), "file", "record")


def by_rank(rows: DataFrame, group: str, order: str) -> DataFrame:
    """First row of each rank in `order`, ranks below the group's row count only, seq_id by rank from 0.

    Counts and first rows are summed up before they are shuffled, and numbers come from range partitions, so a group may be the table."""
    sizes = rows.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("__n"))
    first = rows.where("rank >= 0").groupBy(F.col(group).alias("__group"), F.col("rank").alias("__rank")).agg(F.min_by(F.struct(*rows.columns), order).alias("__row"))
    kept = first.join(sizes.withColumnRenamed("__group", "__of"), F.col("__group").eqNullSafe(F.col("__of"))).where("__rank < __n").select("__row.*")
    return numbered(kept, [group], "rank", name="seq_id").drop(order)


def known_instances(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Instances of the block after the first line that holds `dataset`, up to the next header."""
    rows = lines(spark, path).where(~F.lower("line").contains("instances"))
    begin = rows.where(F.col("line").contains(dataset)).groupBy("file").agg(F.min("at").alias("begin"))
    after = rows.join(begin, "file").where("at > begin")
    end = after.where(F.col("line").startswith(">")).groupBy("file").agg(F.min("at").alias("end"))
    block = after.join(end, "file", "left").where("end is null or at < end")
    return block.select("file", "at", instance(F.col("line")).alias("i")).select("file", "at", "i.*")


def instance(line) -> F.col:
    """(seq_id, start, substring, length, end) of a `seq,start,substring,length` text; a start is relative to the sequence's end."""
    part = lambda i: F.get(F.split(line, ","), F.lit(i))
    start, length = part(1).try_cast("int"), part(3).try_cast("int")
    return F.struct(part(0).try_cast("int").alias("seq_id"), start.alias("start"), F.trim(part(2)).alias("substring"), length.alias("length"), (start + length).alias("end"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """(file, pattern, label, seq_id, start, substring, length, end) of a result file: `>pattern`, label, `>instances`, rows."""
    rows = so_far(lines(spark, path), F.col("line").startswith(">pattern"), "pattern").where("pattern > 0")
    label = rows.where(~F.col("line").startswith(">")).where(~F.col("line").contains(",")).groupBy("file", "pattern").agg(F.min_by("line", "at").alias("label"))
    body = rows.where(~F.col("line").startswith(">")).where(F.col("line").contains(",")).select("file", "pattern", "at", instance(F.col("line")).alias("i"))
    return body.join(label, ["file", "pattern"]).select("file", "pattern", "label", "at", "i.*")


def peaks(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, rank, chr, start, end, length, fdr, summit, maxlog2fc) of a peak table with one header line."""
    part = F.split(F.trim("line"), r"\s+")
    names = [("rank", 0, "int"), ("chr", 1, "string"), ("start", 2, "int"), ("end", 3, "int"), ("length", 5, "int"), ("fdr", 6, "double"), ("summit", 9, "int"), ("maxlog2fc", 14, "double")]
    return lines(spark, path).where("at > 0 and length(trim(line)) > 0").select("file", "at", *[F.get(part, F.lit(i)).try_cast(kind).alias(name) for name, i, kind in names])


def cut_peaks(peak_table: DataFrame, genome: DataFrame, end_inclusive: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sequences and bundles of peaks: (rank, seq, fdr, maxlog2fc, summit from the peak's start, length_differs).

    genome: (chr, seq). The letters from start to end, with the end itself by default, in upper case.
    """
    size = F.col("end") - F.col("start") + (1 if end_inclusive else 0)
    rows = peak_table.join(genome, "chr")
    seq = F.upper(F.substring("seq", F.col("start") + 1, size))
    return rows.select(*keep, "rank", seq.alias("seq"), "fdr", "maxlog2fc", (F.col("summit") - F.col("start")).alias("summit"), (F.length(seq) != F.col("length")).alias("length_differs"))


def convert_peaks(spark: SparkSession, folder: str, genome: DataFrame, destination: str, names: DataFrame | None = None, suffix: str = ".cod") -> DataFrame:
    """Turn every peak table of a folder into a FASTA file of peaks and a bundle file, named like the table, in one job: (name, peaks).

    A peak's letters end before its last position here. `names` (name) is a list of the files to take. Rows are range-partitioned by file
    and rank order, so a table of any size is spread over tasks; what fills several files becomes a folder of that name.
    """
    tables = peaks(spark, f"{folder.rstrip('/')}/*{suffix}")
    tables = (allowed(tables, names) if names is not None else tables).withColumn("name", F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1))
    rows = cut_peaks(tables, genome, end_inclusive=False, keep=("name", "at"))
    rows = stored(rows.withColumn("head", F.concat(F.lit("> id="), F.col("rank").cast("string"))))
    number = lambda c: F.format_string("%.6f", F.col(c))
    scores = F.concat(F.lit("FDR,"), number("fdr"), F.lit("\nmaxlog2FC,"), number("maxlog2fc"), F.lit("\nsummit,"), F.col("summit").cast("string"))
    write_by_name(rows.select("name", "at", F.concat_ws("\n", "head", "seq").alias("value")), destination, ".fasta", "at")
    write_by_name(rows.select("name", "at", F.concat_ws("\n", "head", scores).alias("value")), destination, ".bundle", "at")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("peaks"))


def write_by_name(rows: DataFrame, destination: str, suffix: str, *order: str, whole: bool = False) -> None:
    """rows: (name, value, ...). Write one text file, or a folder of part files in order, for each name; with `whole` always one file,
    which is then written by one task."""
    folder = Folder(rows.sparkSession, destination)
    attempt = f"_attempt-{uuid.uuid4().hex}"
    dealt = rows.repartition("name") if whole else rows.repartitionByRange("name", *order)
    dealt.sortWithinPartitions("name", *order).select("name", "value").write.partitionBy("name").text(folder.at(attempt))
    for part in Folder(rows.sparkSession, folder.at(attempt)).names():
        if part.startswith("name="):
            files = [f for f in Folder(rows.sparkSession, folder.at(f"{attempt}/{part}")).names() if f.startswith("part-")]
            made = unquote(part.removeprefix("name=")) + suffix
            folder.delete(made)
            folder.rename(f"{attempt}/{part}/{files[0]}" if len(files) == 1 else f"{attempt}/{part}", made)
    folder.delete(attempt)


def pfm(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, base, count): one header line, then rows for A, C, G and T; counts are cut to whole numbers."""
    rows = lines(spark, path).where("at between 1 and 4")
    base = F.element_at(F.array(*map(F.lit, "ACGT")), F.col("at").cast("int"))
    cells = rows.select("file", base.alias("base"), F.posexplode(F.array_remove(F.split(F.regexp_replace("line", r"[A-Za-z\[\]]", " "), r"\s+"), "")).alias("pos", "value"))
    return cells.select("file", "pos", "base", F.col("value").cast("double").cast("long").alias("count"))


def meme_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, base, count) of rows of four counts in the order A C G T."""
    rows = so_far(lines(spark, path).where("length(trim(line)) > 0"), F.lit(True), "pos", own=False)
    cells = rows.select("file", "pos", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("i", "value"))
    return cells.select("file", "pos", F.element_at(F.array(*map(F.lit, "ACGT")), F.col("i") + 1).alias("base"), F.col("value").cast("long").alias("count"))


def gff_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, seq): the attribute `sequence=` of the ninth column, after one header line."""
    return lines(spark, path).where("at > 0").select("file", "at", F.regexp_extract(F.get(F.split("line", "\t"), F.lit(8)), r"(?:^|;)\s*sequence=([^;]*)", 1).alias("seq")).where("seq <> ''")


def glam_sites(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, seq_id, start, end, text): one header line; a site's tokens lie between the second and the third last."""
    part = F.split(F.trim("line"), r"\s+")
    text = F.translate(F.upper(F.array_join(F.slice(part, 3, F.greatest(F.size(part) - 5, F.lit(0))), "")), ".", "")
    return lines(spark, path).where("at > 0 and length(trim(line)) > 0").select("file", "at", part[0].cast("int").alias("seq_id"), part[1].cast("int").alias("start"), F.get(part, F.size(part) - 3).cast("int").alias("end"), text.alias("text"))


def worker_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: the summed third and eleventh words of its report lines, and the summed NEW-PATTERNS(n)."""
    part = F.split("line", r"\s+")
    found = F.regexp_extract("line", r"NEW-PATTERNS\((\d+)\)", 1).try_cast("long")
    return lines(spark, path).groupBy("file").agg(F.sum(F.get(part, F.lit(2)).try_cast("long")).alias("third"), F.sum(F.get(part, F.lit(10)).try_cast("long")).alias("eleventh"), F.sum(found).alias("new_patterns"))
