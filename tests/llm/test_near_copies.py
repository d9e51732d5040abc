import random

import corpus_pipeline

from motifmill.llm import common, simhash


def brute_kept(rows):
    """One row of each group: fingerprints that differ in 3 bits at most are linked."""
    fps = [simhash.fingerprint((t or "").encode()) & (1 << 64) - 1 for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        least.setdefault(g, []).append((i is None, i or 0))
    return sorted(min(ids) for ids in least.values())


def test_one_document_of_each_group(spark, odd, documents):
    long = " ".join(f"w{i}" for i in range(400))
    more = [(None, "lost id"), (None, "another text without an id"), (20, long), (20, long + " w400"), (20, long), (None, long), (19, long), (None, None)]
    extra = spark.createDataFrame([(*r, "k", 0) for r in more], odd.schema)
    df = odd.unionByName(extra).select("doc_id", "text").unionByName(documents.select("doc_id", "text").limit(150))
    rows = [tuple(r) for r in df.collect()]
    out = corpus_pipeline.dedup_near_copies(spark, df, "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == brute_kept(rows)
    assert len(out) < len(rows) and {tuple(r) for r in out} <= set(rows)
    assert sum(r["text"] == "lost id" for r in out) == 1 and sum((r["text"] or "").startswith("w0 w1 ") for r in out) == 1


def test_texts_that_stay_are_not_moved(spark, monkeypatch, tmp_path):
    """Of a table too large for broadcasts, texts without a copy are neither stored again nor shuffled; copies go all the same."""
    r = random.Random(5)
    rows = [(i, " ".join(f"{r.getrandbits(60):x}" for _ in range(400))) for i in range(600)]
    docs = tmp_path / "docs"
    spark.createDataFrame([*rows, *((1000 + i, rows[i][1]) for i in range(12)), *[rows[20]] * 3], "doc_id long, text string").write.parquet(str(docs))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path / "shared"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    try:
        before = written()
        out = corpus_pipeline.dedup_near_copies(spark, spark.read.parquet(str(docs)), "").collect()
        moved = written() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    again = sum(f.stat().st_size for f in (tmp_path / "shared").rglob("*.parquet"))
    assert sorted(tuple(x) for x in out) == rows
    size = sum(len(t) for _, t in rows)
    assert moved < 0.3 * size and again < 0.3 * size
