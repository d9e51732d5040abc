"""Line deduplication with suffix classes by distributed prefix doubling. DataFrame functions only.

A document is a sequence of line ids. After k doublings every suffix of every document has a class: all suffixes that agree
in their first 2^k lines, which is an interval of the suffix array whose longest common prefix is at least 2^k. Classes are
named by their earliest suffix instead of by a rank; equality of names and the earliest copy are all that is needed. The
class of 2^(k+1) lines is that of the pair (class at i, class at i + 2^k). Suffixes whose class has one member leave at
once, so only repeated text takes part after the first count.

A maximal repeated run of at least `min_words` words is the union of its shortest windows of that many words, read from
every line on and back from every line. A window of n lines is named by the classes of its first and last 2^k lines, with
2^k <= n < 2^(k+1), so all windows whose k is reached are compared exactly. The lines of each window that an earlier copy
precedes are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, split_by_marks, stored, text_of

MIN_WORDS = 50
_BLANK = r"[\x20\x09-\x0D]+"


def _doc_key(id_col: str) -> Column:
    """Identity and order of a document: its id (a null id first) and its text's hash, so that a rescan finds it again."""
    return F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(text_of()).alias("h"))


def _words(line: Column) -> Column:
    return F.size(F.array_remove(F.split(line, _BLANK), ""))


def repeated_lines(docs: DataFrame, id_col: str) -> DataFrame:
    """Every line that occurs twice or more: (doc, line, words, name); name is the place of its first copy. Lines are told apart by
    their MD5, of 128 bits."""
    lines = docs.select(_doc_key(id_col).alias("doc"), F.posexplode(F.split(text_of(), "\n")).alias("line", "value"))
    lines = lines.select("doc", "line", F.unhex(F.md5("value")).alias("id"), F.when(F.length("value") > 0, _words(F.col("value"))).otherwise(0).alias("words"))
    lines = stored(lines, "lines")
    place = F.struct("doc", "line")
    first = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("name")).where("n > 1").drop("n")
    first = stored(first, "first")  # both sides of the join are dealt out afresh, so that Spark can split a common line
    found = stored(lines.join(first, "id").select("doc", "line", "words", "name").dropDuplicates(["doc", "line"]), "repeated")
    drop_stored(docs.sparkSession, lines, first)
    return found


def windows(repeated: DataFrame, min_words: int) -> DataFrame:
    """(doc, line, n): the shortest windows of `min_words` words of neighbouring repeated lines, from and up to each line."""
    by_doc = Window.partitionBy("doc").orderBy("line")
    gap = F.coalesce(F.col("line") - F.lag("line").over(by_doc), F.lit(0)) != 1
    rows = repeated.withColumn("part", F.sum(gap.cast("int")).over(by_doc))
    upto = F.sum("words").over(Window.partitionBy("doc", "part").orderBy("line"))
    rows = rows.withColumn("upto", upto).select("doc", "part", "line", F.col("upto").cast("long").alias("upto"), (F.col("upto") - F.col("words")).alias("before"))
    # A window from line a ends at the first line whose running total reaches before(a) + min_words; one up to line b starts
    # at the last line whose total before it is at most upto(b) - min_words. Both are found by sorting totals and asks.
    event = lambda value, kind, asks: F.struct(value.cast("long").alias("value"), F.lit(kind).alias("kind"), F.col("line"), F.lit(asks).alias("asks"))
    forward = rows.select("doc", "part", F.explode(F.array(event(F.col("upto"), 1, False), event(F.col("before") + min_words, 0, True))).alias("e")).select("doc", "part", "e.*")
    backward = rows.select("doc", "part", F.explode(F.array(event(F.col("before"), 0, False), event(F.col("upto") - min_words, 1, True))).alias("e")).select("doc", "part", "e.*")
    mark = F.when(~F.col("asks"), F.col("line"))
    falling = Window.partitionBy("doc", "part").orderBy(F.desc("value"), F.desc("kind"), F.desc("line")).rowsBetween(Window.unboundedPreceding, 0)
    rising = Window.partitionBy("doc", "part").orderBy("value", "kind", "line").rowsBetween(Window.unboundedPreceding, 0)
    ahead = forward.withColumn("other", F.last(mark, ignorenulls=True).over(falling)).where("asks and other is not null").select("doc", "line", (F.col("other") - F.col("line") + 1).alias("n"))
    back = backward.withColumn("other", F.last(mark, ignorenulls=True).over(rising)).where("asks and other is not null").select("doc", F.col("other").alias("line"), (F.col("line") - F.col("other") + 1).alias("n"))
    return ahead.unionByName(back).where("n > 0").distinct()


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id") -> DataFrame:
    """(doc, line) of every line to delete."""
    repeated = repeated_lines(docs, id_col)
    wanted = stored(windows(repeated, min_words), "windows")
    longest = wanted.agg(F.max("n")).first()[0] or 0
    classes, size, found = repeated.select("doc", "line", "name"), 1, []
    while size <= longest:
        sized = wanted.where((F.col("n") >= size) & (F.col("n") < 2 * size)).withColumn("last", F.col("line") + F.col("n") - size)
        named = sized.join(classes.withColumnRenamed("name", "head"), ["doc", "line"]).join(classes.select("doc", F.col("line").alias("last"), F.col("name").alias("tail")), ["doc", "last"])
        named = stored(named.select("doc", "line", "n", "head", "tail"), "named")
        copies = named.groupBy("n", "head", "tail").agg(F.min(F.struct("doc", "line")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
        copies = stored(copies, "copies")  # as in repeated_lines: a window that most documents share can be split
        found.append(named.join(copies, ["n", "head", "tail"]).where(F.struct("doc", "line") > F.col("first")).select("doc", F.explode(F.sequence(F.col("line"), F.col("line") + F.col("n") - 1)).alias("line")))
        if 2 * size <= longest:
            pairs = stored(classes.join(classes.select("doc", (F.col("line") - size).alias("line"), F.col("name").alias("next")), ["doc", "line"]), "pairs")
            first = pairs.groupBy("name", "next").agg(F.min(F.struct("doc", "line")).alias("longer"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
            first = stored(first, "first")
            classes = stored(pairs.join(first, ["name", "next"]).select("doc", "line", F.col("longer").alias("name")), "classes")
            drop_stored(docs.sparkSession, pairs, first)
        size *= 2
    lines = found[0] if found else repeated.select("doc", "line").where("false")
    for more in found[1:]:
        lines = lines.unionByName(more)
    return lines.distinct()


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", counts: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """`docs` with later copies of repeated line runs deleted from `text`, and two columns appended: the lines before, and those
    deleted.

    The first copy in the order of id, then line, stays; a run that repeats within a document loses its later copies too.
    Lines are split at \\n and must agree byte for byte (as their MD5 tells); runs of fewer than `min_words` words stay. Documents whose text
    doesn't change keep it as it is, null included (no lines); a text that loses all its lines becomes empty. Rows that
    repeat both id and text are the same document and get the same result. An empty table gives an empty result. Other
    columns pass through; those named as `counts` are replaced.
    """
    gone = later_copies(docs, min_words, id_col)
    w = Window.partitionBy("doc").orderBy("line")
    islands = gone.withColumn("island", F.col("line") - F.row_number().over(w)).groupBy("doc", "island").agg(F.min("line").alias("s"), F.max("line").alias("e"))
    cuts = islands.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("__cuts")).select(F.col("doc.d").alias("__d"), F.col("doc.h").alias("__h"), "__cuts")
    cuts = stored(cuts, "cuts")
    key, names = _doc_key(id_col), [c for c in docs.columns if c not in counts]
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], key["d"].alias("__d"), key["h"].alias("__h"))
    cut, whole = split_by_marks(keyed, "__h", cuts.select(F.col("__h").alias("key")))  # texts without cuts stay where they are
    joined = cut.join(cuts, ["__d", "__h"], "left").unionByName(whole.withColumn("__cuts", F.lit(None).cast(cuts.schema["__cuts"].dataType)))
    lines = F.split(text_of(), "\n")
    from_line = F.concat(F.array(F.lit(0)), F.transform("__cuts", lambda c: c["e"] + 1))
    to_line = F.concat(F.transform("__cuts", lambda c: c["s"]), F.array(F.size(lines)))
    kept = F.flatten(F.transform(F.arrays_zip(from_line.alias("f"), to_line.alias("t")), lambda r: F.slice(lines, r["f"] + 1, r["t"] - r["f"])))
    text = F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    deleted = F.when(F.col("__cuts").isNull(), 0).otherwise(F.aggregate("__cuts", F.lit(0), lambda n, c: n + c["e"] - c["s"] + 1))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names], count.cast("long").alias(counts[0]), deleted.cast("long").alias(counts[1]))
