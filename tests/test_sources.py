from pyspark.sql import functions as F

from motifmill.operators import pools
from motifmill.plans import commands
from motifmill.sources import readers, writers
from motifmill.streaming import pool_stream


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_fasta_and_bundle(spark, tmp_path):
    path = put(tmp_path, "a.fasta", ">1\nACG\nTT\n>2\nGG")
    assert [(r["seq_id"], r["seq"]) for r in readers.fasta(spark, path).orderBy("seq_id").collect()] == [(0, "ACG"), (1, "TT"), (2, "GG")]
    assert [(r["seq_id"], r["seq"]) for r in readers.fasta(spark, path, records=True).orderBy("seq_id").collect()] == [(0, "ACGTT"), (1, "GG")]
    path = put(tmp_path, "a.bundle", "> id=3\nFDR,0.5\nmaxlog2FC,2.25\nsummit,7\n> id=4\nsummit,9\n")
    assert [tuple(r)[1:] for r in readers.bundle(spark, path).orderBy("seq_id").collect()] == [(0, 3, 0.5, 2.25, 7), (1, 4, None, None, 9)]


def test_peak_fasta(spark, tmp_path):
    path = put(tmp_path, "p.fa", "".join(f"> id={r}\n{s}\n> scores\nFDR,1\nsummit,{i}\n" for i, (r, s) in enumerate([(2, "AC"), (0, "GG"), (2, "TT"), (9, "CC")])))
    assert [(r["seq_id"], r["rank"], r["seq"], r["summit"]) for r in readers.peak_fasta(spark, path).orderBy("seq_id").collect()] == [(0, 0, "GG", 1), (1, 2, "AC", 0)]


def test_instances(spark, tmp_path):
    path = put(tmp_path, "sites.txt", "> other\n0,-5,AA,2\n> my data\n> instances\n")
    path = put(tmp_path, "sites.txt", "other\n>instances\n0,-5,AA,2\nmy data\n>instances\n1,-9,ACG,3\n2,-4,GG,2\n>next\n3,-1,A,1\n")
    assert [(r["seq_id"], r["start"], r["substring"], r["length"], r["end"]) for r in readers.known_instances(spark, path, "my data").orderBy("at").collect()] == [(1, -9, "ACG", 3, -6), (2, -4, "GG", 2, -2)]


def test_matrices_and_sites(spark, tmp_path):
    got = {(r["pos"], r["base"]): r["count"] for r in readers.pfm(spark, put(tmp_path, "m.pfm", ">MA1\n1.9 2\n3 4\n5 6\n7 8\n")).collect()}
    assert got == {(0, "A"): 1, (1, "A"): 2, (0, "C"): 3, (1, "C"): 4, (0, "G"): 5, (1, "G"): 6, (0, "T"): 7, (1, "T"): 8}
    got = {(r["pos"], r["base"]): r["count"] for r in readers.meme_counts(spark, put(tmp_path, "m.meme", " 1 2 3 4\n5 6 7 8\n")).collect()}
    assert got[0, "A"] == 1 and got[1, "T"] == 8 and len(got) == 8
    assert [r["seq"] for r in readers.gff_sequences(spark, put(tmp_path, "m.gff", "##gff\nc\ts\tf\t1\t2\t.\t+\t.\tname=a; sequence=ACGT; x=1\n")).collect()] == ["ACGT"]
    r = readers.glam_sites(spark, put(tmp_path, "g.txt", "head\n3 10 ac.g tt 15 + 9.1\n")).first()
    assert (r["seq_id"], r["start"], r["end"], r["text"]) == (3, 10, 15, "ACGTT")
    r = readers.worker_reports(spark, put(tmp_path, "w.txt", "a b 3 c d e f g h i 4 NEW-PATTERNS(5)\na b 1 c d e f g h i 1 NEW-PATTERNS(2)\n")).first()
    assert (r["third"], r["eleventh"], r["new_patterns"]) == (4, 5, 7)


def test_peaks(spark, tmp_path):
    path = put(tmp_path, "p.cod", "h\n1 chrX 2 5 + 4 0.1 a b 3 c d e f 2.5\n")
    genome = spark.createDataFrame([("chrX", "aacgtttt")], "chr string, seq string")
    row = readers.cut_peaks(readers.peaks(spark, path), genome).first()
    assert (row["rank"], row["seq"], row["summit"], row["length_differs"], row["maxlog2fc"]) == (1, "CGTT", 1, False, 2.5)
    assert readers.cut_peaks(readers.peaks(spark, path), genome, end_inclusive=False).first()["seq"] == "CGT"


def test_results_round_trip_and_checkpoint(spark, tmp_path):
    seqs = spark.createDataFrame([(0, "ACGTACGT"), (1, "TTACG")], "seq_id long, seq string")
    occ = spark.createDataFrame([("p", 0, 0, 3), ("p", 1, 2, 4), ("q", 0, 4, 2)], "pattern string, seq_id long, start int, size int")
    labels = spark.createDataFrame([("p", "ACG"), ("q", "AC")], "pattern string, label string")
    writers.write_results(occ, labels, seqs, str(tmp_path / "r"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "r").glob("part-*")))
    got = readers.results(spark, put(tmp_path, "all.txt", text)).collect()
    assert {(r["label"], r["seq_id"], r["start"], r["substring"], r["length"]) for r in got} == {("ACG", 0, -8, "ACG", 3), ("ACG", 1, -3, "ACG", 4), ("AC", 0, -4, "AC", 2)}
    writers.save_checkpoint(str(tmp_path / "c"), occ=occ, labels=labels)
    back = writers.load_checkpoint(spark, str(tmp_path / "c"))
    assert set(back) == {"occ", "labels"} and back["occ"].count() == 3
    assert writers.checkpoint_name("ds", [5, 6], [1, 1]) == "ds_f5-6_d1-1"


def test_pool_stream(spark, tmp_path):
    schema = "pattern string, label string, ssmart double, summit double, jaspar double"
    rows = [(f"p{i}", f"L{i}", float(i), float(i), float(i)) for i in range(20)]
    every = spark.createDataFrame(rows, schema)
    every.where("summit < 10").coalesce(1).write.parquet(str(tmp_path / "in"))
    every.where("summit >= 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = pool_stream.start_pool(stream, str(tmp_path / "pool"), str(tmp_path / "cp"), 4)
    q.processAllAvailable()
    q.stop()
    got, expected = pool_stream.current_pool(spark, str(tmp_path / "pool")), pools.pools(every, 4)
    assert {tuple(r) for r in got.select("pool", "rank", "label").collect()} == {tuple(r) for r in expected.select("pool", "rank", "label").collect()}


def test_commands(spark, tmp_path):
    fasta = put(tmp_path, "s.fasta", "".join(f">{i}\n{'ACGATA' * 3}{'GT' * i}\n" for i in range(4)))
    bundle = put(tmp_path, "s.bundle", "".join(f"> id={i}\nFDR,0\nmaxlog2FC,{i}\nsummit,5\n" for i in range(4)))
    pfm = put(tmp_path, "m.pfm", ">m\n8 1 0 10 2 4\n1 7 0 0 2 3\n1 1 10 0 2 2\n0 1 0 0 4 2\n")
    commands.main(["SLD", "--level", "3", "--kmin", "3", "--kmax", "3", "--output", str(tmp_path / "n")])
    assert spark.read.parquet(str(tmp_path / "n")).count() == 64 * 9
    commands.main(["FLD", "--level", "2-3", "--kmin", "2", "--kmax", "3", "--output", str(tmp_path / "f")])
    assert spark.read.parquet(str(tmp_path / "f")).where("k = 2").count() > 0
    commands.main(["MFC", "--sequences", fasta, "--bundle", bundle, "--pfm", pfm, "--frames", "4", "--distances", "0", "--generations", "2", "--output", str(tmp_path / "out")])
    out = writers.load_checkpoint(spark, str(tmp_path / "out/data_f4_d0"))
    assert out["lexicon"].count() > 0 and out["pools"].count() > 0 and out["occurrences"].agg(F.max("generation")).first()[0] >= 1
    text = "".join(f.read_text() for f in sorted((tmp_path / "out/data_f4_d0/results").glob("part-*")))
    results, sites = put(tmp_path, "r.txt", text), put(tmp_path, "k.txt", "data\n>instances\n0,-18,ACGATA,6\n")
    commands.main(["ARS", "--results", results, "--sites", sites, "--sequences", fasta, "--output", str(tmp_path / "ars")])
    assert spark.read.parquet(str(tmp_path / "ars")).agg(F.max("sTP")).first()[0] == 1
    small = put(tmp_path, "small.txt", ">pattern\nACG\n>instances\n0,-5,ACG,3\n1,-5,AG,2\n")
    commands.main(["SDM", "--results", small, "--output", str(tmp_path / "sdm")])
    assert spark.read.parquet(str(tmp_path / "sdm")).count() == 4
    commands.main(["ALG", "--results", small, "--output", str(tmp_path / "alg")])
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "alg")).collect()) == ["A-G", "ACG"]
