from pyspark.sql import functions as F

from motifmill.operators import chain, index, observe, windows

SEQS = [(0, "ATCGATCGAT"), (1, "TTATCGATAA")]


def table(spark):
    return spark.createDataFrame(SEQS, "seq_id long, seq string")


def places(rows, *keys):
    out = {}
    for r in rows.collect():
        out.setdefault(tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]], set()).add((r["seq_id"], r["start"], r["size"]))
    return out


def test_frames(spark):
    seqs = spark.createDataFrame([(0, "ACGTA"), (1, "ACG"), (2, ""), (3, "AC"), (4, "ACGT" * 300)], "seq_id long, seq string")
    n = lambda **o: {r["seq_id"]: r["count"] for r in windows.frames(seqs, 3, **o).groupBy("seq_id").count().collect()}
    assert n() == {0: 2, 4: 1197} and n(include_last=True) == {0: 3, 1: 1, 4: 1198} and n(at_least_one=True) == {0: 2, 1: 1, 4: 1197}
    assert all(r["frame"] == ("ACGT" * 300)[r["start"] : r["start"] + 3] for r in windows.frames(seqs, 3).where("seq_id = 4").collect())


def test_observation_golden(spark):
    got = places(observe.observe(table(spark), 3), "label")
    assert got == {
        "ATA": {(1, 6, 3)}, "ATC": {(0, 0, 3), (0, 4, 3), (1, 2, 3)}, "CGA": {(0, 2, 3), (0, 6, 3), (1, 4, 3)}, "GAT": {(0, 3, 3), (1, 5, 3)},
        "TAT": {(1, 1, 3)}, "TCG": {(0, 1, 3), (0, 5, 3), (1, 3, 3)}, "TTA": {(1, 0, 3)},
    }


def grown(spark, label, q, quorum=2, **o):
    seen = observe.observe(table(spark), 3)
    lexicon = observe.lexicon(observe.support(seen), quorum)
    words = index.onsequence(seen, lexicon)
    first = seen.where(F.col("label") == label).withColumn("pattern", F.col("label"))
    return places(chain.chain_step(first, words, table(spark), 1, 1, q, **o), "label")


def test_chain_golden(spark):
    expected = {"ATCCGA": {(0, 0, 5), (0, 4, 5), (1, 2, 5)}, "ATCGAT": {(0, 0, 6), (1, 2, 6)}}
    assert grown(spark, "ATC", 2) == grown(spark, "ATC", 2, end_bound="python", dedup=True) == expected
    assert grown(spark, "CGA", 1) == {"CGAATC": {(0, 2, 5)}, "CGATCG": {(0, 2, 6)}, "CGACGA": {(0, 2, 7)}}


def test_support_shrinks_as_patterns_grow(spark):
    seen = observe.observe(table(spark), 3)
    words = index.onsequence(seen, observe.support(seen))
    out = chain.grow(seen.withColumn("pattern", F.col("label")), words, table(spark), 1, 1, 1, 3)
    q = {r["pattern"]: r["q"] for r in observe.support(out, "pattern").collect()}
    assert len({r[0] for r in out.select("generation").distinct().collect()}) > 2
    assert all(q[p] <= q[p.rpartition("|")[0]] for p in q if "|" in p)


def test_neighbours_are_observed_and_counted_alike(spark):
    seqs = table(spark)
    slow = {r["label"]: (r["q"], r["n"]) for r in observe.support(observe.observe(seqs, 3, 1, (2, 4))).collect()}
    fast = {r["label"]: (r["q"], r["n"]) for r in observe.observe_support(seqs, 3, 1, (2, 4)).collect()}
    assert slow == fast and slow["ATC"][0] == 2 and {len(x) for x in slow} == {2, 3, 4}


def test_lexicons(spark):
    sup = spark.createDataFrame([("A", 5), ("B", 5), ("C", 4), ("D", 2), ("E", 2), ("F", 1)], "label string, q long")
    names = lambda df: {r["label"] for r in df.collect()}
    assert names(observe.lexicon(sup, 4)) == {"A", "B", "C"} and names(observe.lexicon(sup, 2, exact=True)) == {"D", "E"}
    assert names(observe.filled_lexicon(sup, 4)) == set("ABCDE") and names(observe.filled_lexicon(sup, 99)) == set("ABCDEF") and names(observe.filled_lexicon(sup, 1, 4)) == set("ABC")
    assert observe.trie_nodes(spark.createDataFrame([("AAT",), ("ATT",)], "label string")).first()["nodes"] == 6


def test_brief_and_index(spark):
    seqs = spark.createDataFrame([(0, "A" * 10), (1, "ACGTACGTAC"), (2, "AC")], "seq_id long, seq string")
    bundles = spark.createDataFrame([(0, 1.0, 5), (1, 3.0, 9), (2, 3.0, 1)], "seq_id long, maxlog2fc double, summit long")
    rows = windows.brief(seqs, bundles, 2, 4).orderBy("new_id").collect()
    assert [(r["seq_id"], r["seq"], r["summit"]) for r in rows] == [(1, "TAC", 2), (2, "AC", 1)]
    words = index.onsequence(observe.observe(seqs, 3), spark.createDataFrame([("ACG",)], "label string"))
    assert {(r["seq_id"], r["words"]) for r in index.analysis(words, seqs).collect()} == {(0, 0), (1, 2), (2, 0)}
    occ = observe.observe(seqs, 3).where("label = 'CGT'")
    row = index.bitmaps(occ, spark.createDataFrame([("CGT",)], "label string")).select(F.bitmap_count("bitmap").alias("bits"), "covered").first()
    assert row["bits"] == row["covered"] == 6


def test_supports_by_bitmaps_of_sparse_ids(spark):
    seqs = spark.createDataFrame([(i, s) for i, (_, s) in zip((-(1 << 62), 1 << 61, 7), [*SEQS, (2, "ACGTAC")], strict=True)], "seq_id long, seq string")
    want = {r["label"]: (r["q"], r["n"]) for r in observe.support(observe.observe(seqs, 3, 1, (2, 4))).collect()}
    assert {r["label"]: (r["q"], r["n"]) for r in observe.observe_support(seqs, 3, 1, (2, 4)).collect()} == want


def test_supports_by_start_equal_counted_places(spark):
    for more in ([], [(1, "TTATCGA"), (1, "AAAA"), (None, "ATCGAA"), (5, None)]):
        seqs = spark.createDataFrame([*SEQS, (2, "ACGTNAC"), *more], "seq_id long, seq string")
        want = sorted(map(tuple, observe.support(observe.observe(seqs, 3, 1, (2, 4)), "label", "start").select("label", "start", "q", "n").collect()))
        assert sorted(map(tuple, observe.observe_support_by_start(seqs, 3, 1, (2, 4)).select("label", "start", "q", "n").collect())) == want


def test_supports_by_start_make_no_occurrences(spark):
    """Windows are counted and stored before they meet their neighbours, so no sequence is in the rest of the plan where no id repeats."""
    plan = observe.observe_support_by_start(table(spark), 3, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "seq_id" not in plan
