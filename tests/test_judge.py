"""Pools as a stream's state: micro-batches end in the batch pools, and so does a restart from the checkpoint."""

from __future__ import annotations

import random

import pytest

from motifmill.operators import pools
from motifmill.streaming import judge

SCHEMA = "pattern string, label string, ssmart double, summit double, jaspar double"


@pytest.mark.parametrize("shards", [1, 3])
def test_restarts_end_in_the_batch_pools(spark, tmp_path, shards):
    judge.use_state_store(spark)
    pick = random.Random(shards)
    rows = [(f"p{i}", f"L{i % 37}", float(pick.randint(0, 30)), float(pick.randint(0, 30)), None if i % 11 == 0 else float(i % 13)) for i in range(120)]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    seen = []
    for batch in (rows[:50], rows[50:53], rows[53:]):  # the query is stopped and started again between them
        seen += batch
        spark.createDataFrame(batch, SCHEMA).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = judge.judged(stream, 20, shards=shards).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()
        frame = spark.createDataFrame(seen, SCHEMA)
        want = pools.merged(pools.pools(frame, 1000), pools.pools(frame.limit(0)), 20)
        assert sorted(judge.judged_pool(spark, out, 20).collect()) == sorted(want.select("pool", "rank", "pattern", "label", "score").collect())
    told = judge.answers(spark, out).collect()
    assert len(told) == 120 * 2 + 120 - sum(r[4] is None for r in rows)
    assert {r["rank"] >= 0 for r in told} == {True, False}
    if shards == 1:
        final = {(r["pool"], r["label"], r["score"]): r["rank"] for r in judge.judged_pool(spark, out, 20).collect()}
        refused = {(r["pool"], r["label"], r["score"]) for r in told if r["rank"] < 0}
        assert not refused & set(final)  # what was refused never comes in later
