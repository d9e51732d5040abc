"""Text files over many splits, batches of peak tables, masks and colours, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from motifmill.operators import evaluate, index
from motifmill.operators.numbering import running_sum
from motifmill.sources import readers


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_splits):
    pick = random.Random(8)
    records = [(f"r{i}", ["".join(pick.choice("ACGT") for _ in range(pick.randint(0, 70))) for _ in range(pick.randint(0, 4))]) for i in range(60)]
    text = "".join(f"> {name}\r\n" + "".join(line + "\n" for line in lines) for name, lines in records)
    (tmp_path / "big.fasta").write_text(text + "\n")
    (tmp_path / "other.fasta").write_text("ACGT\n>x\nTT")
    (tmp_path / "empty.fasta").write_text("")
    rows = readers.lines(spark, str(tmp_path))
    assert rows.where("file like '%big.fasta'").select("block").distinct().count() > 10
    got = {(r["file"].rpartition("/")[2], r["at"]): r["line"] for r in rows.collect()}
    want = {("big.fasta", i): x.rstrip("\r") for i, x in enumerate((text + "\n").split("\n")[:-1])} | {("other.fasta", i): x for i, x in enumerate(["ACGT", ">x", "TT"])}
    assert got == want
    big = readers.fasta(spark, str(tmp_path / "big.fasta"), names=True).orderBy("seq_id").collect()
    flat = [(name, line) for name, lines in records for line in lines] + [(records[-1][0], "")]
    assert [(r["seq_id"], r["name"], r["seq"]) for r in big] == [(i, *x) for i, x in enumerate(flat)]
    joined = readers.fasta(spark, str(tmp_path / "big.fasta"), records=True).orderBy("seq_id").collect()
    last = {i: "".join(lines) for i, (_, lines) in enumerate(records) if lines or i == len(records) - 1}
    assert [r["seq"] for r in joined] == list(last.values())
    assert [tuple(r)[1:] for r in readers.fasta(spark, str(tmp_path / "other.fasta")).orderBy("seq_id").collect()] == [(0, "ACGT"), (1, "TT")]


def test_peak_tables_of_a_folder(spark, tmp_path, small_splits):
    genome = spark.createDataFrame([("c1", "acgtacgtacgtacgtacgt"), ("c2", "t" * 50)], "chr string, seq string")
    head = "rank chr start end strand length fdr x y summit a b c d maxlog2fc\n"
    for name, chrom, n in (("one", "c1", 9), ("two", "c2", 1), ("three", "c1", 2)):
        (tmp_path / f"{name}.cod").write_text(head + "".join(f"{i} {chrom} {i} {i + 5} + 6 0.25 0 0 {i + 2} 0 0 0 0 {i}.5\n" for i in range(n)))
    out = str(tmp_path / "out")
    names = spark.createDataFrame([("one.cod",), ("two.cod",)], "name string")
    assert {tuple(r) for r in readers.convert_peaks(spark, str(tmp_path), genome, out, names).collect()} == {("one", 9), ("two", 1)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith((".", "_"))) == ["one.bundle", "one.fasta", "two.bundle", "two.fasta"]
    seqs = readers.fasta(spark, f"{out}/one.fasta", names=True).collect()
    assert {(r["name"], r["seq"]) for r in seqs} == {(f"id={i}", ("ACGT" * 5)[i : i + 5]) for i in range(9)}
    bundle = readers.bundle(spark, f"{out}/one.bundle").collect()
    assert {(r["rank"], r["fdr"], r["maxlog2fc"], r["summit"]) for r in bundle} == {(i, 0.25, i + 0.5, 2) for i in range(9)}


def test_masks_carry_over_words(spark):
    pick = random.Random(3)
    occ = [(p, s, pick.randint(0, 300), pick.randint(1, 9)) for p in "ab" for s in (1, 2) for _ in range(12)] + [("a", 3, 0, 1), ("a", 3, 60, 3), ("b", 3, 60, 4)]
    words = [(s, pos, pick.choice("xy")) for s in (1, 2, 3) for pos in range(0, 380, 3)]
    patterns = spark.createDataFrame(occ, "pattern string, seq_id long, start int, size int")
    starts = spark.createDataFrame(words, "seq_id long, pos int, label string")
    for overlap, gap in ((0, 0), (2, 3), (40, 63)):
        band = {(p, s, start + size + d) for p, s, start, size in occ for d in range(-overlap, gap + 1) if start + size + d >= 0}
        assert {tuple(r) for r in index.positions(index.next_masks(patterns, overlap, gap)).collect()} == band
        both = {(p, s, pos) for p, s, pos in band if (s, pos) in {(a, b) for a, b, _ in words}}
        assert {tuple(r) for r in index.positions(index.candidates(patterns, starts, overlap, gap)).collect()} == both
        pairs = {}
        for p, s, pos in band:
            for a, b, label in words:
                if (a, b) == (s, pos):
                    pairs.setdefault((p, label), set()).add(s)
        assert {(r["pattern"], r["label"]): r["q"] for r in index.pair_supports(patterns, starts, overlap, gap).collect()} == {k: len(v) for k, v in pairs.items()}
    with pytest.raises(ValueError, match="from 0 to 63"):
        index.next_masks(patterns, 64, 0)


def test_colours_and_running_sums(spark):
    seqs = spark.createDataFrame([(5, "A" * 7), (2, "A" * 10), (9, ""), (11, "A" * 20)], "seq_id long, seq string")
    occ = spark.createDataFrame([("p", 5, 1), ("p", 11, 0), ("q", 11, 4), ("q", 11, 4), ("r", 2, 30), ("s", 2, 9)], "pattern string, seq_id long, start int")
    coloured = evaluate.colours(occ, seqs, 4)
    assert {tuple(r) for r in coloured.collect()} == {("p", 2), ("q", 5), ("s", 2)}
    assert {tuple(r) for r in evaluate.coloured_starts(occ, coloured).collect()} == {(2, 5, 1, 1), (2, 11, 0, 1), (5, 11, 4, 2), (2, 2, 9, 1)}
    rows = spark.createDataFrame([(g, i) for g in ("a", None) for i in range(40)], "g string, i int").repartition(5)
    got = running_sum(rows, ["g"], F.col("i"), "i", name="s").collect()
    assert len(got) == 80 and all(r["s"] == sum(range(r["i"])) for r in got)
