"""Pools kept up to date over a stream of scored patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import pools


def start_pool(scores: DataFrame, path: str, checkpoint: str, most: int = pools.POOL_SIZE) -> StreamingQuery:
    """Merge every micro-batch of (pattern, label, ssmart, summit, jaspar) into the pools stored below `path`.

    Each batch writes a new version from the last one, both of bounded size; a batch that runs again after a failure overwrites its
    own version, so every batch counts once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        fresh = pools.pools(batch, most)
        if number:
            fresh = pools.merged(batch.sparkSession.read.parquet(f"{path}/version={number - 1}"), fresh, most)
        fresh.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={number}")

    return scores.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append").start()


def current_pool(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of stored pools."""
    versions = spark.read.parquet(path)
    newest = versions.agg({"version": "max"}).first()[0]
    return versions.where(versions["version"] == newest).drop("version")
