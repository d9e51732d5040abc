"""Pools as the state of a stream: each scored pattern is answered when it comes, and the pool is what it is answered from.

The state of a pool (a shard of it) is its best entries, at most `most`; they outlive restarts in the checkpoint. A micro-batch's
patterns of a pool pass through one task as a stream of small frames. With several shards a pool's patterns are spread over as many
tasks, each with a state of its own; the pool is the merger of these, exactly, while an answer then tells the rank in its shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import pools

#: answer: a pattern's rank in the pool when its batch had been merged, -1 for none. entry: the pool after that batch.
SCHEMA = "pool string, shard int, version long, kind string, rank int, pattern string, label string, score double"


class Pool(StatefulProcessor):
    """The best entries of one (pool, shard); `signs` as in `operators.pools`."""

    def __init__(self, most: int, signs: dict[str, int]):
        self.most, self.signs = most, signs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "pattern string, label string, score double")
        self.version = handle.getValueState("version", "version long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sign = self.signs[key[0]]
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        best = {(label, score): pattern for pattern, label, score in (self.entries.get() if self.entries.exists() else ())}
        asked: list[pd.DataFrame] = []
        order = lambda x: (sign * x[0][1], x[0][0], x[1])
        for frame in rows:
            frame = frame.dropna(subset=["score"])
            asked.append(frame[["pattern", "label", "score"]])
            for pattern, label, score in asked[-1].itertuples(index=False):
                best[label, score] = min(pattern, best.get((label, score), pattern))
            best = dict(sorted(best.items(), key=order)[: self.most])
        rank = {k: i for i, k in enumerate(best)}
        self.entries.put([(pattern, label, score) for (label, score), pattern in best.items()])
        self.version.update((version,))
        head = {"pool": key[0], "shard": int(key[1]), "version": version}
        for frame in asked:
            ranks = [rank.get(k, -1) for k in zip(frame["label"], frame["score"], strict=True)]
            yield frame.assign(**head, kind="answer", rank=ranks)[[c.split()[0] for c in SCHEMA.split(", ")]]
        own = pd.DataFrame([(p, la, s) for (la, s), p in best.items()], columns=["pattern", "label", "score"])
        yield own.assign(**head, kind="entry", rank=range(len(own)))[[c.split()[0] for c in SCHEMA.split(", ")]]

    def close(self) -> None:
        pass


def judged(scores: DataFrame, most: int = pools.POOL_SIZE, signs: dict[str, int] = pools.SIGNS, shards: int = 1) -> DataFrame:
    """The answers and pools (SCHEMA) of a stream of (pattern, label, one column a score)."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("pool"), F.col(n).cast("double").alias("score")) for n in signs]))
    rows = scores.select("pattern", "label", F.pmod(F.xxhash64("pattern"), F.lit(shards)).cast("int").alias("shard"), each.alias("e")).select("e.pool", "shard", "pattern", "label", "e.score")
    return rows.groupBy("pool", "shard").transformWithStateInPandas(Pool(most, signs), SCHEMA, "Append", "None")


def start_judge(scores: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Judge a stream into Parquet files below `path`. The state store must be RocksDB: `use_state_store`."""
    return judged(scores, **options).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(path)


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(pool, pattern, label, score, rank): how each pattern was answered."""
    return spark.read.parquet(path).where("kind = 'answer'").select("pool", "pattern", "label", "score", "rank")


def judged_pool(spark: SparkSession, path: str, most: int = pools.POOL_SIZE, signs: dict[str, int] = pools.SIGNS) -> DataFrame:
    """(pool, rank, pattern, label, score): the newest version of each shard, merged."""
    rows = spark.read.parquet(path).where("kind = 'entry'")
    newest = rows.groupBy("pool", "shard").agg(F.max("version").alias("version"))
    entries = rows.join(newest, ["pool", "shard", "version"]).groupBy("pool", "label", "score").agg(F.min("pattern").alias("pattern"))
    sign = F.element_at(F.create_map(*[x for k, v in signs.items() for x in (F.lit(k), F.lit(v))]), F.col("pool"))
    rank = F.row_number().over(Window.partitionBy("pool").orderBy(sign * F.col("score"), "label", "pattern")) - 1  # at most `most` rows a shard
    return entries.withColumn("rank", rank).where(F.col("rank") < most).select("pool", "rank", "pattern", "label", "score")
