"""Top-k pools of scored patterns: (pattern, label, ssmart, summit, jaspar)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The scores' order and signs (a pool is ascending in sign * score), the pools' size, and what counts as a hit when patterns
#: are pruned.
SIGNS = {"ssmart": -1, "summit": 1, "jaspar": -1}
POOL_SIZE, GOOD_RANK, PERMITTED_LENGTH, LEAST_HITS = 100, 25, 30, 2


def ranked(scores: DataFrame, score: str, most: int = POOL_SIZE, signs: dict[str, int] = SIGNS) -> DataFrame:
    """The pool of one score with its rank from 0; ties by label, then pattern. The limit lets every task keep its best alone."""
    signed = F.col(score) * signs[score]
    top = scores.where(F.col(score).isNotNull()).orderBy(signed, "label", "pattern").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(signed, "label", "pattern")) - 1)  # at most `most` rows


def pools(scores: DataFrame, most: int = POOL_SIZE, signs: dict[str, int] = SIGNS) -> DataFrame:
    """(pool, rank, pattern, label, score) of all pools: the three usual ones, or one for each score column that `signs` names."""
    out = None
    for name in signs:
        one = ranked(scores, name, most, signs).select(F.lit(name).alias("pool"), "rank", "pattern", "label", F.col(name).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def merged(a: DataFrame, b: DataFrame, most: int = POOL_SIZE, signs: dict[str, int] = SIGNS) -> DataFrame:
    """The pools of two sets of pools; an entry of the same label and score in both counts once."""
    both = a.unionByName(b).groupBy("pool", "label", "score").agg(F.min("pattern").alias("pattern"))
    sign = F.element_at(F.create_map(*[x for k, v in signs.items() for x in (F.lit(k), F.lit(v))]), F.col("pool"))
    rank = F.row_number().over(Window.partitionBy("pool").orderBy(sign * F.col("score"), "label", "pattern")) - 1
    return both.withColumn("rank", rank).where(F.col("rank") < most).select("pool", "rank", "pattern", "label", "score")


def report(pool: DataFrame, first: int = 10) -> DataFrame:
    """The first entries of each pool and its last one."""
    last = F.max("rank").over(Window.partitionBy("pool"))  # pools are bounded
    return pool.withColumn("last", last).where((F.col("rank") < first) | (F.col("rank") == F.col("last"))).drop("last")


def ranks(scores: DataFrame, most: int = POOL_SIZE, signs: dict[str, int] = SIGNS) -> DataFrame:
    """Every pattern's rank in each pool, -1 where it has none: (pattern, label, one column `<score>_rank` a score)."""
    out = scores.select("pattern", "label")
    for name in signs:
        rank = F.col(f"{name}_rank")
        out = out.join(F.broadcast(ranked(scores, name, most, signs).select("pattern", F.col("rank").alias(f"{name}_rank"))), "pattern", "left").withColumn(f"{name}_rank", F.coalesce(rank, F.lit(-1)))  # at most `most` rows
    return out


def in_any_pool(signs: dict[str, int] = SIGNS) -> Column:
    """For `ranks`: the pattern is in one of the pools."""
    return F.greatest(F.lit(-1), *[F.col(f"{name}_rank") for name in signs]) >= 0


def accepted_native() -> Column:
    """Grow on if the pattern is in the summit or the matrix pool."""
    return (F.col("summit_rank") != -1) | (F.col("jaspar_rank") != -1)


def accepted_python(compat: bool = False) -> Column:
    """Grow on if more than two points come together: one for a good rank (two for the matrix pool), three for a short label. With
    `compat` no rank counts as a good one, as it did in the original method."""
    good = lambda c: F.when((F.col(c) <= GOOD_RANK) & (F.lit(compat) | (F.col(c) >= 0)), 1).otherwise(0)
    points = good("ssmart_rank") + good("summit_rank") + 2 * good("jaspar_rank") + F.when(F.length("label") <= PERMITTED_LENGTH, 3).otherwise(0)
    return points > LEAST_HITS
