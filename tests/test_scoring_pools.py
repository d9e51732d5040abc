import math

import pytest
from pyspark.sql import functions as F

from motifmill.operators import pools, scorers, scoring

PFM = {"A": [8, 1, 0, 10, 2, 4], "C": [1, 7, 0, 0, 2, 3], "G": [1, 1, 10, 0, 2, 2], "T": [0, 1, 0, 0, 4, 2]}


@pytest.fixture(scope="module")
def pwm(spark):
    return scoring.matrix(spark.createDataFrame([(i, b, n) for b, row in PFM.items() for i, n in enumerate(row)], "pos int, base string, count long")).cache()


def test_matrix_golden(pwm):
    got = {(r["pos"], r["base"]): (round(r["fwd"], 6), round(r["rev"], 6)) for r in pwm.collect()}
    assert [got[0, b][0] for b in "ACGT"] == [1.584963, -1.137504, -1.137504, -3.459432]
    assert [got[5, b][0] for b in "ACGT"] == [0.5025, 0.115477, -0.415037, -0.415037]
    assert [got[0, b][1] for b in "ACGT"] == [-0.289507, -0.289507, 0.241008, 0.628031]
    assert [got[5, b][1] for b in "ACGT"] == [-3.584963, -1.263034, -1.263034, 1.459432]


def test_best_alignments_golden(spark, pwm):
    texts = spark.createDataFrame([("ACGATA",), ("GA",), ("TATCGTAA",), ("ACGATAACGATA",)], "text string")
    got = {r["text"]: (round(r["fwd"], 6), r["fwd_end"], round(r["rev"], 6), r["rev_end"]) for r in scoring.matrix_scores(texts, pwm).collect()}
    assert got == {"ACGATA": (7.910284, 6, 1.256062, 6), "GA": (3.796241, 2, 0.869039, 2), "TATCGTAA": (1.584963, 8, 7.910284, 6), "ACGATAACGATA": (7.910284, 12, 1.256062, 12)}
    assert {r["text"] for r in scoring.matrix_scores(texts, pwm, partial=False).collect()} == {"ACGATA", "TATCGTAA", "ACGATAACGATA"}


def test_three_scores(spark, pwm):
    seqs = spark.createDataFrame([(0, "ACGATAACGA"), (1, "GGGGACGATA"), (2, "TTTTTTTTTT")], "seq_id long, seq string")
    bundles = spark.createDataFrame([(0, 3.0, 5), (1, 1.0, 5), (2, 0.5, 5)], "seq_id long, maxlog2fc double, summit long")
    occ = spark.createDataFrame([("p", 0, 0, 6), ("p", 0, 6, 6), ("p", 1, 4, 6), ("q", 2, 0, 4)], "pattern string, seq_id long, start int, size int")
    got = {r["pattern"]: r for r in scorers.score_patterns(occ, scorers.Context(seqs, bundles, pwm)).collect()}
    assert got["p"]["ssmart"] == 2.0 - 0.5 and got["q"]["ssmart"] == 0.5 - 2.0
    assert got["p"]["summit"] == (2 + 4 + 2) / 3 and got["q"]["summit"] == 3
    best = {r["text"]: max(r["fwd"], r["rev"]) for r in scoring.matrix_scores(spark.createDataFrame([("ACGATA",), ("ACGA",)], "text string"), pwm).collect()}
    assert math.isclose(got["p"]["jaspar"], (2 * best["ACGATA"] + max(best["ACGA"], 0)) / 3)
    everywhere = spark.createDataFrame([("r", i, 0, 4) for i in range(3)], "pattern string, seq_id long, start int, size int")
    assert scoring.ssmart(everywhere, bundles).first()["ssmart"] == 1.5


def test_pools(spark):
    scores = spark.createDataFrame([(f"p{i}", f"L{i}", float(i % 7), float(i), float(-i)) for i in range(30)], "pattern string, label string, ssmart double, summit double, jaspar double")
    pool = pools.pools(scores, 5)
    got = {p: [r["label"] for r in pool.where(F.col("pool") == p).orderBy("rank").collect()] for p in pools.SIGNS}
    assert got == {"ssmart": ["L13", "L20", "L27", "L6", "L12"], "summit": ["L0", "L1", "L2", "L3", "L4"], "jaspar": ["L0", "L1", "L2", "L3", "L4"]}
    assert pools.merged(pool, pool, 5).count() == 15
    assert [r["rank"] for r in pools.report(pools.pools(scores, 20), 10).where("pool = 'summit'").orderBy("rank").collect()] == [*range(10), 19]
    ranked = pools.ranks(scores, 5)
    assert {r["label"] for r in ranked.where(pools.accepted_native()).collect()} == {"L0", "L1", "L2", "L3", "L4"}
    far = ranked.withColumn("label", F.rpad("label", 31, "x"))
    assert far.where(pools.accepted_python()).count() == 5 and far.where(pools.accepted_python(compat=True)).count() == 30 and ranked.where(pools.accepted_python()).count() == 30
