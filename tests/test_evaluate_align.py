import random

from pyspark.sql import functions as F

from motifmill.operators import align, evaluate


def test_raw_statistics_golden(spark):
    seqs = spark.createDataFrame([(i, "A" * 15) for i in range(3)], "seq_id long, seq string")
    sites = spark.createDataFrame([("a", 0, -13, 5), ("b", 1, -9, 6), ("c", 2, -12, 4)], "site_id string, seq_id long, rel_start int, length int")
    motifs = spark.createDataFrame([(str(i), *m) for i, m in enumerate([(0, -14, 2), (0, -10, 3), (0, -4, 3), (2, -6, 4), (1, -8, 4), (2, -14, 3)])], "motif_id string, seq_id long, rel_start int, length int")
    row = evaluate.raw_statistics(motifs, sites, seqs).first().asDict()
    assert row == {"nTP": 8, "nFN": 7, "nFP": 11, "nTN": 19, "sTP": 3, "sFN": 0, "sFP": 2}
    one = evaluate.raw_statistics_by(motifs.selectExpr("'p' as pattern", "*"), sites, seqs).first().asDict()
    assert one == row | {"pattern": "p"}
    assert {(r["motif_id"], r["site_id"], r["overlap"]) for r in evaluate.site_overlaps(motifs, sites, seqs).collect()} == {("0", "a", 1), ("1", "a", 2), ("4", "b", 4), ("5", "c", 1)}


def test_distances(spark):
    words = ["CAGCGGCTGCGGA", "CGCTGCCACCGCTG", "GTCGCAGTCGCTGCC"]
    got = {(r["a"], r["b"]): r["distance"] for r in evaluate.distance_matrix(spark.createDataFrame([("g", w) for w in words], "group string, text string")).collect()}
    assert len(got) == 9 and got[words[0], words[1]] == 8 and got[words[0], words[2]] == 9


def test_graph(spark):
    found = spark.createDataFrame([("p", "AC"), ("p", "AC"), ("q", "AG"), ("q", "AA"), ("r", "AC")], "pattern string, text string")
    labels = spark.createDataFrame([("p", "AA"), ("q", "AC"), ("r", "AG")], "pattern string, label string")
    edges = evaluate.similar(found, labels)
    assert {tuple(r) for r in edges.collect()} == {("p", "q"), ("r", "q"), ("q", "r"), ("q", "p")}
    assert {tuple(r) for r in evaluate.mutual(edges).collect()} == {("p", "q"), ("q", "p"), ("q", "r"), ("r", "q")}


def test_histograms_and_best_per_sequence(spark):
    occ = spark.createDataFrame([(0, 0, 4), (0, 0, 4), (1, 3, 2)], "seq_id long, start int, size int")
    bundles = spark.createDataFrame([(0, 2), (1, 5)], "seq_id long, summit long")
    assert {r["delta"]: r["n"] for r in evaluate.centrality(occ, bundles).collect()} == {-2: 0, -1: 0, 0: 1, 1: 1, 2: 0}
    assert {(r["seq_id"], r["n"]) for r in evaluate.start_histogram(occ).collect()} == {(0, 2), (1, 1)}
    scored = spark.createDataFrame([(0, 0, 2.0, 5), (0, 4, 2.0, 1), (1, 0, -1.0, 3)], "seq_id long, start int, score double, distance long")
    assert evaluate.one_per_sequence(scored).first().asDict() == {"best_score": 2.0, "best_score_distance": 5.0, "least_distance": 2.0, "least_distance_score": 0.5}


def test_alignment(spark):
    same = spark.createDataFrame([("g", i, "AATTTCGGG") for i in range(5)], "group string, id long, text string")
    assert align.consensus(same).first()["consensus"] == 1.0
    rows = spark.createDataFrame([("g", 0, "ACGT"), ("g", 1, "AGT"), ("g", 2, "ACGTT"), ("h", 0, "")], "group string, id long, text string")
    out = align.align(rows).where("group = 'g'").orderBy("id").collect()
    assert len({len(r["text"]) for r in out}) == 1 and [r["text"].replace("-", "") for r in out] == ["ACGT", "AGT", "ACGTT"]
    gaps = spark.createDataFrame([("g", 0, "A-"), ("g", 1, "A-"), ("g", 2, "AC")], "group string, id long, text string")
    assert align.consensus(gaps).first()["consensus"] == 0.5
    part = align.segment(spark.createDataFrame([("g", 0, "-ACG-"), ("g", 1, "-ACG-")], "group string, id long, text string")).first()
    assert (part["first"], part["last"]) == (1, 3)
    m = align.segment_matrix(spark.createDataFrame([("g", 0, "-ACG-"), ("g", 1, "-ACG-")], "group string, id long, text string")).collect()
    assert len(m) == 12 and max(m, key=lambda r: (r["pos"] == 0, r["fwd"]))["base"] == "A"


def test_statistics_by_pattern_count_motifs_that_meet_nothing(spark):
    """For each pattern the same as raw_statistics of its motifs alone: empty ones, some outside their sequence, some of unknown ones."""
    pick = random.Random(6)
    seqs = spark.createDataFrame([(i, "A" * n) for i, n in enumerate([0, 30, 1500, 700])], "seq_id long, seq string")
    interval = lambda: (pick.randint(0, 5), pick.randint(-1600, 1600), pick.choice([0, 1, 4, 40, 900]))
    sites = spark.createDataFrame([(f"s{i}", *interval()) for i in range(25)], "site_id string, seq_id long, rel_start int, length int")
    rows = [(pick.choice("pqr"), f"m{i}", *interval()) for i in range(120)] + [("out", "mx", 9, 0, 5), ("out", "my", 1, 40, 5)]
    motifs = spark.createDataFrame(rows, "pattern string, motif_id string, seq_id long, rel_start int, length int")
    by = {r["pattern"]: r.asDict() for r in evaluate.raw_statistics_by(motifs, sites, seqs).collect()}
    assert set(by) == {"p", "q", "r", "out"}
    for pattern, got in by.items():
        assert got == evaluate.raw_statistics(motifs.where(F.col("pattern") == pattern), sites, seqs).first().asDict() | {"pattern": pattern}
    assert evaluate.raw_statistics_by(motifs, sites.limit(0), seqs).where("pattern = 'out' and sFP = 2 and sTP = 0 and nFN = 0").count() == 1
    assert evaluate.raw_statistics_by(motifs.limit(0), sites, seqs).count() == 0
