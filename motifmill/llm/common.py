"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of a worker's word memo, and as many old ones.
MEMO_LIMIT = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all run in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame, kind: str = "table", by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts the lineage and survives lost executors. `by`: a column of few
    values whose rows get folders of their own, so that they can be dropped apart."""
    path, schema = new_path(df.sparkSession, kind), T._parse_datatype_json_string(df.schema.json())
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Collect garbage on the driver: Spark deletes the shuffle files of a plan when the driver no longer holds it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_stored(spark: SparkSession, *frames: DataFrame, only: str = "") -> None:
    """Delete stored tables that nothing reads any more; `only`: of a table stored `by` a column the folder of one value."""
    for df in frames:
        for file in {f.rpartition("/")[0] for f in df.inputFiles() if f"/{only}" in f}:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(file)
            jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


#: Bits of a row of a table of marks (512 words of 64), and most bits of all, so that 8 MB are broadcast at most.
CHUNK_BITS, MOST_MARK_BITS = 1 << 15, 1 << 26


def split_by_marks(rows: DataFrame, key: str, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` in two, without a shuffle: those whose `key` (a long column) may be among `marks` (key), and those whose key isn't.

    A bitmap of 8 to 16 bits a mark is broadcast; with more marks than it has room for, more rows are in the first part for nothing.
    """
    bits = min(MOST_MARK_BITS, max(CHUNK_BITS, 1 << (8 * marks.count()).bit_length()))
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(bits))
    words = marks.select(place("key").alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("set"))
    chunks = words.groupBy(F.shiftright("word", 9).alias("__chunk")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(511), "set"))).alias("sets"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(511).cast("long"))
    chunks = stored(chunks.select("__chunk", F.transform(every, lambda i: F.coalesce(F.col("sets")[i], F.lit(0).cast("long"))).alias("__bits")), "marks")
    met = rows.withColumn("__place", place(key)).join(F.broadcast(chunks), F.shiftright("__place", 15) == F.col("__chunk"), "left")
    hit = F.coalesce(F.expr("shiftright(__bits[cast(shiftright(__place, 6) & 511 as int)], cast(__place & 63 as int)) & 1L") == 1, F.lit(False))
    part = lambda where: met.where(where).drop("__place", "__chunk", "__bits")
    return part(hit), part(~hit)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


#: UTF-8 bytes of text that Spark puts into one batch for Python, a single longer row apart.
BATCH_BYTES = 4 << 20
#: Bytes of a text that are split into tokens at a time.
RUN_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches for Python workers end by their bytes, not only by their rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def text_runs(text: bytes | memoryview, run_bytes: int | None = None) -> Iterator[bytes]:
    """A text in runs of at most about RUN_BYTES and one word that end at white space."""
    at, size, run_bytes = 0, len(text), run_bytes or RUN_BYTES
    while at < size:
        found = _SPACE.search(text, at + run_bytes - 1) if at + run_bytes < size else None
        end = found.end() if found else size
        yield bytes(text[at:end])
        at = end


def token_runs(text: bytes | memoryview | None, end: bytes | None = None, run_bytes: int | None = None) -> Iterator[list[bytes]]:
    """The words of a text in lower case (A-Z), some 100,000 at a time; `end` is one more after the last."""
    last: list[bytes] = []
    for run in text_runs(memoryview(text) if text is not None else b"", run_bytes):
        if last:
            yield last
        last = run.lower().split()
    if end is not None:
        last.append(end)
    if last:
        yield last


class Memo(dict):
    """A bounded memo of a function of one word: when it is full, its entries become the old ones, from which those still in use
    come back, and it starts afresh."""

    def __init__(self, make: Callable, limit: int = MEMO_LIMIT):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self.put(word, value)
        return value

    def put(self, word, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value


#: What a worker keeps between tasks, by what it is for: at most one memo or tokenizer.
_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    """What `make` returned for `key`, for all tasks of a worker until one asks for another key. A worker that serves one stage
    after the other holds the memo of one only."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget_kept() -> None:
    """A task that needs nothing of what its worker keeps lets it go."""
    _KEPT.clear()


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, pa.RecordBatch], dict]], schema: str, keeps: bool = False) -> DataFrame:
    """mapInArrow over a frame with a `text` column: `make()` runs once per task and returns a function from the texts as
    UTF-8 bytes and the batch to columns. Batches end at BATCH_BYTES of text, so that memory holds that or one longer text.
    `keeps`: what the worker keeps is used, else it is let go."""
    names = T._parse_datatype_string(schema).fieldNames()
    arrow = _arrow_schema(df.sparkSession, schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget_kept()
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
                out = work(texts, batch)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, arrow.field(n).type) for n, x in ((n, out[n]) for n in names)], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))
