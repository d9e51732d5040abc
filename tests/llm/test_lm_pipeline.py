import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from pyspark.sql import functions as F

from motifmill.llm import lm_scoring as lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [" "]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


def brute_base(rows):
    count = Counter()
    for i, t in rows:
        if not held(i):
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    return [(i, held(i), len(tokens(t)), sum(w in count for w in tokens(t)), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 4)) for i, t in rows]


@pytest.mark.parametrize("most", [1 << 18, 300])
def test_lm_scores(spark, documents, odd, monkeypatch, most):
    monkeypatch.setattr(lm, "GROUPED", 200)
    monkeypatch.setattr(lm, "TAIL_CODES", 5000)
    monkeypatch.setattr(lm.head_of, "__defaults__", (most,))
    df = documents.withColumn("kept", F.lit("k")).withColumn("n_lines", F.col("n_chars").cast("int")).select("doc_id", "text", "kept", "n_lines").unionByName(odd)
    df = df.withColumn("fold", F.lit(1)).withColumn("score", F.lit("x")).withColumn("block", F.lit(0))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = lm.score_documents(df).collect()
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out]
    key = lambda r: (str(r[:5]), r[5])
    for a, b in zip(sorted(got, key=key), sorted(brute_base(rows), key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-3
    own = [r for r in out if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own) and all(r["score"] < 0 for r in out)


def test_lm_probabilities_sum_to_one():
    """Over all outcomes, of classes and in classes, after a history that training has, one that it lacks in part, and a new one."""
    rng = np.random.default_rng(0)
    mass, classes = rng.integers(1, 50, 40).astype(float), rng.integers(0, 5, 40)
    outcomes = lm.Outcomes.of(mass, classes)
    key = lambda a, b, c: np.uint64((a << 42) + (b << 21) + c)
    events = Counter((int(key(rng.integers(3), rng.integers(3), rng.integers(3))), int(rng.integers(40))) for _ in range(400))
    for h in (key(0, 1, 2), key(1, 2, 9), key(2, 9, 9), key(9, 9, 9)):
        every = sorted(set(events) | {(int(h), w) for w in range(40)})
        keys, outcome, n = np.array([k for k, _ in every], np.uint64), np.array([w for _, w in every]), np.array([events[e] for e in every], float)
        scores = np.add(*lm.train_and_score(keys, outcome, n, outcomes.log_class[outcomes.classes[outcome]], outcomes.log_word[outcome], outcomes.classes))
        assert abs(np.exp(scores[keys == h]).sum() - 1) < 1e-9


def test_lm_without_training_or_rows(spark):
    i = next(i for i in range(99) if held(i))
    row = lm.score_documents(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).first()
    assert (row["n_known"], row["train_tokens"], row["base_score"], abs(row["score"])) == (0, 0, 0.0, abs(row["score"]))
    assert abs(row["score"] + 3 * math.log10(lm.TAIL_CODES)) < 1e-2  # hashed codes are equally likely
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_history():
    block = lm.Block({"codes": lm.packed(np.array([5, 6, 7, 8, 9], "<i4")), "size": [2, 2], "lead": [0, 1], "fold": [0, 1]}, 1)
    assert block.before(1).tolist() == [0, 6, 0, 8, 9] and block.before(3).tolist() == [0, 0, 0, 0, 0]
    assert block.own.tolist() == [True, True, False, True, True] and block.training.tolist() == [True, True, False, False, False]
    bits = lm.CODE_BITS
    assert block.keys(100)[4] == (9 << 2 * bits) + (8 << bits) and block.keys(8)[4] == (1 << 3 * bits) + (8 << 2 * bits) + (9 << bits)


def test_pipeline(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, columns = docs, docs.columns
    ids = [r[0] for r in docs.select("doc_id").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf_dir)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == columns
            now = [r[0] for r in after.select("doc_id").collect()]
            assert set(now) <= set(ids) and len(now) == len(set(now)) and (name == "line_dedup" and now and len(now) == len(ids) or name != "line_dedup")
            ids = now
        before = after
    pieces = before.collect()
    assert {r["doc_id"] for r in pieces} == set(ids)
    whole = {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32").collect()}
    assert sum(r["length"] for r in pieces) == sum(r[2] for r in whole) and {r["doc_id"] for r in pieces} == {r[0] for r in whole}


def test_stages_take_odd_rows(spark, odd):
    sf_dir, docs = "/root/testdata/sf0.001", odd.selectExpr("doc_id", "text", "kept as lang", "kept as source", "cast(length(text) as long) as n_chars", "kept as cuts", "n_lines")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.where("false")):
            out = stage(spark, df, sf_dir)
            assert name == "packing" or out.columns == docs.columns
            rows = out.collect()
            assert name == "packing" or {(r["n_lines"], r["cuts"]) for r in rows} <= {(r["n_lines"], r["cuts"]) for r in docs.collect()}
