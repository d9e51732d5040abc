"""Column functions over k-mers of the alphabet ATCG."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters in the order of their codes.
ALPHABET = "ATCG"


def heap_code(kmer: Column) -> Column:
    """Code of a k-mer in the complete 4-ary tree: the root is 1, and level L takes (4^L - 1)/3 + 1 to (4^(L+1) - 1)/3."""
    return F.aggregate(F.array_remove(F.split(kmer, ""), ""), F.lit(1).cast("long"), lambda code, letter: 4 * code + 2 - F.instr(F.lit(ALPHABET), letter))


def heap_kmer(code: Column, most: int = 31) -> Column:
    """The k-mer of a code, of at most `most` letters; a code of 64 bits has 31 at most, and coding longer words is an error."""
    step = lambda acc: F.struct(F.shiftright(acc["code"] + 2, 2).alias("code"), F.concat(F.substring(F.lit(ALPHABET), (4 - (acc["code"] + 2) % 4).cast("int"), F.lit(1)), acc["kmer"]).alias("kmer"))
    start = F.struct(code.cast("long").alias("code"), F.lit("").alias("kmer"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, lambda acc, _: F.when(acc["code"] > 1, step(acc)).otherwise(acc))["kmer"]


def neighbours(kmer: Column) -> Column:
    """Distinct words one deletion, substitution or insertion away, without the k-mer itself."""
    letters = F.array(*map(F.lit, ALPHABET))
    head = lambda n: F.substring(kmer, F.lit(1), n)
    tail = lambda start: F.substring(kmer, start, F.length(kmer))
    at, gap = F.sequence(F.lit(1), F.length(kmer)), F.sequence(F.lit(0), F.length(kmer))
    shorter = F.transform(at, lambda i: F.concat(head(i - 1), tail(i + 1)))
    same = F.flatten(F.transform(at, lambda i: F.transform(letters, lambda x: F.concat(head(i - 1), x, tail(i + 1)))))
    longer = F.flatten(F.transform(gap, lambda i: F.transform(letters, lambda x: F.concat(head(i), x, tail(i + 1)))))
    return F.array_except(F.array_distinct(F.concat(shorter, same, longer)), F.array(kmer))


def complement(base: Column) -> Column:
    return F.translate(base, "ACGT", "TGCA")


def overlap(start_a: Column, length_a: Column, start_b: Column, length_b: Column) -> Column:
    """Shared length of two half-open intervals."""
    return F.greatest(F.lit(0), F.least(start_a + length_a, start_b + length_b) - F.greatest(start_a, start_b))


def log_odds(count: Column, total: Column, pseudocount: float = 1.0) -> Column:
    """log2 of a smoothed share against a quarter."""
    return F.log2((count + pseudocount / 4) / (total + pseudocount) / 0.25)


def text_to_size(text: Column) -> Column:
    """Bytes of a text such as 12KB; null if its suffix is none of b, KB, MB, GB or no number stands before it."""
    number = F.regexp_extract(text, r"^([0-9]+)(b|KB|MB|GB)$", 1).try_cast("long")
    factor = F.when(text.endswith("KB"), 1 << 10).when(text.endswith("MB"), 1 << 20).when(text.endswith("GB"), 1 << 30).otherwise(1)
    return number * factor


def best_segment(values: Column) -> Column:
    """(best, first, last) of the segment of an array with the largest sum, the first such; indices from 0."""
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("from"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x
        better = acc["best"].isNull() | (total > acc["best"])
        return F.struct(
            F.when(better, total).otherwise(acc["best"]).alias("best"),
            F.when(better, acc["from"]).otherwise(acc["first"]).alias("first"),
            F.when(better, acc["at"]).otherwise(acc["last"]).alias("last"),
            F.when(total < 0, 0.0).otherwise(total).alias("sum"),
            F.when(total < 0, acc["at"] + 1).otherwise(acc["from"]).alias("from"),
            (acc["at"] + 1).alias("at"),
        )

    return F.aggregate(F.transform(values, lambda x: x.cast("double")), start, step, lambda acc: F.struct(acc["best"].alias("best"), acc["first"].alias("first"), acc["last"].alias("last")))
