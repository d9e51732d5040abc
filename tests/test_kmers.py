from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motifmill.functions import kmers as fn
from motifmill.operators import neighbourhood


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_heap_codes(spark):
    rows = spark.createDataFrame([(x,) for x in ("A", "T", "C", "G", "AT", "GATTACA", "")], "kmer string").select("kmer", fn.heap_code(F.col("kmer")).alias("code")).withColumn("back", fn.heap_kmer(F.col("code"))).collect()
    assert [r["code"] for r in rows] == [5, 4, 3, 2, 20, 9229, 1]
    assert all(r["back"] == r["kmer"] for r in rows)


def test_heap_codes_of_long_words(spark):
    rows = spark.createDataFrame([("ACGT" * 6 + "GC",), ("A" * 31,), ("G" * 31,)], "kmer string").select("kmer", fn.heap_kmer(fn.heap_code(F.col("kmer"))).alias("back")).collect()
    assert all(r["back"] == r["kmer"] for r in rows)


def test_codes_of_a_level_are_contiguous(spark):
    codes = sorted(r[0] for r in neighbourhood.kmers(spark, 4).select(fn.heap_code(F.col("kmer"))).collect())
    assert codes == list(range((4**4 - 1) // 3 + 1, (4**5 - 1) // 3 + 1))


def test_neighbours(spark):
    rows = spark.createDataFrame([("ATC",), ("GGGGG",), ("ACGTAC",)], "kmer string").select("kmer", fn.neighbours(F.col("kmer")).alias("n")).collect()
    assert [len(r["n"]) for r in rows] == [25, 35, 46]
    assert all(levenshtein(r["kmer"], x) == 1 for r in rows for x in r["n"])


def test_hop_distance_is_edit_distance_between_lengths_and_hamming_within_one(spark):
    for first, last, distance in ((2, 4, levenshtein), (3, 3, lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)))):
        words = [r[0] for r in neighbourhood.kmers(spark, first, last).collect()]
        got = {(r["kmer"], r["neighbour"]): r["distance"] for r in neighbourhood.neighbourhood(neighbourhood.kmers(spark, 3), first, last, 2).collect()}
        assert got == {(a, b): distance(a, b) for a in words if len(a) == 3 for b in words if 1 <= distance(a, b) <= 2}


def test_overlap_log_odds_sizes(spark):
    row = spark.range(1).select(
        fn.overlap(F.lit(-10), F.lit(1), F.lit(-7), F.lit(2)).alias("a"), fn.overlap(F.lit(3), F.lit(4), F.lit(3), F.lit(9)).alias("b"), fn.log_odds(F.lit(8), F.lit(10)).alias("c"), fn.text_to_size(F.lit("3KB")).alias("d"), fn.text_to_size(F.lit("3kb")).alias("e"),
    ).first()
    assert (row["a"], row["b"], round(row["c"], 6), row["d"], row["e"]) == (0, 4, 1.584963, 3072, None)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=12))
def test_best_segment(spark, values):
    row = spark.createDataFrame([(values,)], "v array<int>").select(fn.best_segment(F.col("v")).alias("s")).select("s.*").first()
    sums = {(i, j): sum(values[i : j + 1]) for i in range(len(values)) for j in range(i, len(values))}
    assert row["best"] == max(sums.values()) == sums[row["first"], row["last"]]


def test_store_and_repair(spark, tmp_path):
    path = str(tmp_path / "n")
    all_words = neighbourhood.kmers(spark, 3)
    neighbourhood.write_neighbourhood(neighbourhood.neighbourhood(all_words.where("kmer < 'T'"), 3, 3, 1), path, 3, 3, 1, [3], buckets=3)
    assert neighbourhood.repair(spark, path).count() == 16
    assert spark.read.parquet(path).groupBy("kmer").count().where("count = 9").count() == 64
