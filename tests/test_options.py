"""Options and small operators: deadlines, pools of other scores, stored neighbourhoods, allow-lists, other strands, odd intervals."""

import pytest

from motifmill.operators import align, chain, evaluate, neighbourhood, observe, pools, scoring
from motifmill.sources import readers


def test_deadline(spark):
    seqs = spark.createDataFrame([(i, "ACGTACGTAC") for i in range(3)], "seq_id long, seq string")
    first = observe.observe(seqs, 3).selectExpr("label as pattern", "label", "seq_id", "start", "size")
    words = first.selectExpr("seq_id", "start as pos", "label")
    assert chain.grow(first, words, seqs, 1, 1, 3, 2, seconds=0).agg({"generation": "max"}).first()[0] == 0
    assert chain.grow(first, words, seqs, 1, 1, 3, 1, seconds=600).agg({"generation": "max"}).first()[0] == 1


def test_pools_of_other_scores(spark):
    scores = spark.createDataFrame([("p", "A", 1.0, 3.0), ("q", "C", 2.0, 4.0)], "pattern string, label string, up double, down double")
    got = {(r["pool"], r["rank"]): r["label"] for r in pools.pools(scores, 5, {"up": 1, "down": -1}).collect()}
    assert got == {("up", 0): "A", ("up", 1): "C", ("down", 0): "C", ("down", 1): "A"}


def test_stored_neighbourhood(spark, tmp_path):
    seqs = spark.createDataFrame([(0, "ACGTTA"), (1, "CCGA")], "seq_id long, seq string")
    known = neighbourhood.write_neighbourhood(neighbourhood.neighbourhood(neighbourhood.kmers(spark, 3), 2, 4, 2), str(tmp_path / "n"), 2, 4, 2, [3], buckets=4)
    again = neighbourhood.open_neighbourhood(spark, str(tmp_path / "n"))
    assert (again.kmin, again.kmax, again.dmax, again.levels) == (2, 4, 2, (3,))
    for d, span in ((1, None), (2, (2, 4))):
        for store in (known, again):
            assert sorted(observe.observe(seqs, 3, d, span, known=store).collect()) == sorted(observe.observe(seqs, 3, d, span).collect())
    for k, d, span in ((4, 1, None), (3, 3, (2, 4)), (3, 1, (1, 3)), (3, 1, (3, 5)), (3, 2, (3, 3))):
        with pytest.raises(ValueError, match="holds 2 to 4 letters within 2"):
            observe.observe(seqs, k, d, span, known=known)


def test_stored_neighbourhood_is_joined_by_bucket(spark, tmp_path):
    seqs = spark.createDataFrame([(0, "ACGTTA"), (1, "CCGA")], "seq_id long, seq string")
    known = neighbourhood.write_neighbourhood(neighbourhood.neighbourhood(neighbourhood.kmers(spark, 3), 3, 3, 1), str(tmp_path / "n"), 3, 3, 1, [3], buckets=4)
    least, spark_conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf
    try:
        spark_conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = observe.observe(seqs, 3, 1, known=known)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark_conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_allowed_files(spark, tmp_path):
    for name in ("a.fasta", "b.fasta"):
        (tmp_path / name).write_text(f">1\n{name[0].upper()}\n")
    rows = readers.fasta(spark, str(tmp_path))
    assert [r["seq"] for r in readers.allowed(rows, spark.createDataFrame([("b.fasta",)], "name string")).collect()] == ["B"]


def test_means_and_other_strand(spark):
    pwm = spark.createDataFrame([(0, b, 1.0 if b == "A" else -1.0, 1.0 if b == "T" else -1.0) for b in "ACGT"], "pos int, base string, fwd double, rev double")
    strings = spark.createDataFrame([("A",), ("A",), ("C",), ("",)], "text string")
    assert abs(scoring.mean_matrix_score(strings, pwm).first()["score"] - 1 / 3) < 1e-9
    sites = spark.createDataFrame([(0, 1, 4), (0, 5, 8)], "seq_id long, start int, end int")
    assert scoring.site_centrality(sites, spark.createDataFrame([(0, 5)], "seq_id long, summit long")).first()["summit"] == 2.0
    m = spark.createDataFrame([("g", 0, "A", 1.0), ("g", 1, "C", 2.0)], "group string, pos int, base string, fwd double")
    assert {tuple(r) for r in align.reverse_complement(m).collect()} == {("g", 1, "T", 1.0), ("g", 0, "G", 2.0)}


def test_raw_statistics_of_odd_intervals(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "STRETCH", 4)
    seqs = spark.createDataFrame([(0, "A" * 10)], "seq_id long, seq string")
    motifs = spark.createDataFrame([("a", 0, 1, 8), ("b", 0, 8, 9), ("c", 0, 0, 0), ("d", 7, 0, 3), (None, 0, 2, 2)], "motif_id string, seq_id long, rel_start int, length int")
    sites = spark.createDataFrame([("x", 0, 6, 1), ("y", 0, 0, 1), ("z", 0, 30, 2)], "site_id string, seq_id long, rel_start int, length int")
    row = evaluate.raw_statistics(motifs, sites, seqs).first().asDict()
    assert row == {"nTP": 1, "nFP": 8, "nFN": 1, "nTN": 0, "sTP": 1, "sFN": 2, "sFP": 3}
    empty = evaluate.raw_statistics(motifs.limit(0), sites.limit(0), seqs.limit(0)).first().asDict()
    assert set(empty.values()) == {0}
