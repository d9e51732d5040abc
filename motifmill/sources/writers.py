"""Text renderings and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows
from ..operators.scoring import instances


def instance_lines(occurrences: DataFrame, sequences: DataFrame) -> DataFrame:
    """(pattern, seq_id, start, line) with the lines `seq,start,text,length`; starts are relative to the sequence's end."""
    rows = instances(occurrences, sequences.withColumn("seq_length", F.length("seq")))
    line = F.concat_ws(",", F.col("seq_id").cast("string"), (F.col("start") - F.col("seq_length")).cast("string"), "text", F.col("size").cast("string"))
    return rows.select("pattern", "seq_id", "start", line.alias("line"))


def word_lines(sequences: DataFrame, words: list[str]) -> DataFrame:
    """`instance_lines` of the places of words of one length. A word's place tells its letters, so places of sequences whose id no other has
    become lines where they are; only those of repeated ids are joined."""
    if not words:
        return instance_lines(sequences.select(F.lit("").alias("pattern"), "seq_id", F.lit(0).alias("start"), F.lit(0).alias("size")).where("false"), sequences)
    once, again = windows.by_use_of_id(sequences)
    size = F.length("word")
    line = F.concat_ws(",", F.col("seq_id").cast("string"), (F.col("start") - F.col("seq_length")).cast("string"), "word", size.cast("string"))
    lines = windows.places(once, words).select(F.col("word").alias("pattern"), "seq_id", "start", line.alias("line"))
    return lines.unionByName(instance_lines(windows.places(again, words).select(F.col("word").alias("pattern"), "seq_id", "start", size.alias("size")), again))


def write_results(occurrences: DataFrame, labels: DataFrame, sequences: DataFrame, path: str) -> None:
    """A file set of `>pattern`, label, `>instances` and instance lines, in the order of the patterns. Lines are range-partitioned by
    their whole order, so a pattern of any size is spread over files."""
    head = labels.select("pattern", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit(">pattern").alias("line")), F.struct(F.lit(1).alias("o"), F.col("label").alias("line")), F.struct(F.lit(2).alias("o"), F.lit(">instances").alias("line")))).alias("h"))
    head = head.select("pattern", F.col("h.o").alias("o"), F.lit(-1).cast("long").alias("seq_id"), F.lit(-1).alias("start"), F.col("h.line").alias("line"))
    body = instance_lines(occurrences, sequences).select("pattern", F.lit(3).alias("o"), F.col("seq_id").cast("long").alias("seq_id"), "start", "line")
    head.unionByName(body).repartitionByRange("pattern", "o", "seq_id", "start").sortWithinPartitions("pattern", "o", "seq_id", "start").select("line").write.mode("overwrite").text(path)


def checkpoint_name(dataset: str, frames: list[int], distances: list[int]) -> str:
    """Such as ds_f5-6_d1-1."""
    return f"{dataset}_f{'-'.join(map(str, frames))}_d{'-'.join(map(str, distances))}"


def save_checkpoint(path: str, **tables: DataFrame) -> None:
    """Each table as Parquet below `path`; the manifest is written last, so that a broken checkpoint isn't found."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    next(iter(tables.values())).sparkSession.createDataFrame([(n,) for n in tables], "name string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_checkpoint(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a checkpoint, read when they are used."""
    return {r["name"]: spark.read.parquet(f"{path}/{r['name']}") for r in spark.read.schema("name string").json(f"{path}/manifest").collect()}


def matrix_csv(pwm: DataFrame, path: str) -> None:
    """A row a base, a column a position."""
    pwm.groupBy("base").pivot("pos").agg(F.first("fwd")).orderBy("base").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def rank_table(pool: DataFrame, first: int = 10) -> DataFrame:
    """(pool, rank, line) of the first entries of pools, as a table of labels and scores; its head has rank -1."""
    head = pool.select("pool").distinct().select("pool", F.lit(-1).alias("rank"), F.lit('[rank] "sequence"\tSCORE').alias("line"))
    return head.unionByName(pool.where(F.col("rank") < first).select("pool", "rank", F.format_string('[%d] "%s"\t%.2f', "rank", "label", "score").alias("line")))


def ranks_report(pool: DataFrame, occurrences: DataFrame, sequences: DataFrame, signs: dict[str, int]) -> DataFrame:
    """`report_of_lines` of a pool's instances among the occurrences."""
    return report_of_lines(pool, instance_lines(occurrences.join(pool.select("pattern").distinct(), "pattern", "left_semi"), sequences), signs)


def report_of_lines(pool: DataFrame, lines: DataFrame, signs: dict[str, int]) -> DataFrame:
    """(pool, rank, seq_id, start, line): for every entry a line of its rank and signed score, without seq_id and start, and those of its
    instances, from `lines` (pattern, seq_id, start, line)."""
    sign = F.element_at(F.create_map(*[x for k, v in signs.items() for x in (F.lit(k), F.lit(v))]), F.col("pool"))
    head = pool.select("pool", "rank", F.lit(None).cast("long").alias("seq_id"), F.lit(None).cast("int").alias("start"), F.format_string("index:%d|score:%.6f", F.col("rank"), sign * F.col("score")).alias("line"))
    return head.unionByName(pool.select("pool", "rank", "pattern").join(lines, "pattern").select("pool", "rank", F.col("seq_id").cast("long").alias("seq_id"), F.col("start").cast("int").alias("start"), "line"))
