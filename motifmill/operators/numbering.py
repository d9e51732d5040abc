"""Numbers in order, without a window over a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.state import stored

#: Bits below the partition in monotonically_increasing_id.
_ROW_BITS = 33


def in_order(rows: DataFrame, *order: str | Column) -> DataFrame:
    """`rows` range-partitioned and sorted by `order`, with `__at`: an id that ascends in that order over all partitions.

    A group of any size is spread over as many partitions as it fills, but rows that are equal in all of `order` share one.
    """
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())


def numbered(rows: DataFrame, groups: list[str], *order: str | Column, name: str = "idx", size: str | None = None) -> DataFrame:
    """`rows` with `name`: their number from 0 within their group (null is a group as well) in the given order, and with `size`: the
    rows of the group. Rows equal in all of `order` are numbered one after another in any order.

    The rows are sorted over all partitions and stored once. What is summed up is one row for each partition and group in it: the
    offset of a group's rows in a partition is the number of its rows in those before.
    """
    keys = [F.col(f"`{g}`") for g in groups]
    laid = stored(in_order(rows, *keys, *order)).withColumn("__part", F.shiftright("__at", _ROW_BITS))
    of_group = Window.partitionBy(*[f"__g{i}" for i in range(len(groups))])
    runs = laid.groupBy("__part", *[k.alias(f"__g{i}") for i, k in enumerate(keys)]).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(of_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stored(runs.withColumn("__before", before).withColumn("__size", F.sum("__n").over(of_group)).withColumnRenamed("__part", "__run"))
    same = reduce(lambda a, b: a & b, [F.col("__part") == F.col("__run"), *[k.eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)]])
    out = laid.join(runs, same).withColumn(name, F.col("__at") - F.col("__first") + F.col("__before"))
    out = out.withColumn(size, F.col("__size")) if size else out
    return out.drop("__at", "__part", "__run", "__first", "__n", "__before", "__size", *[f"__g{i}" for i in range(len(groups))])


def running_sum(rows: DataFrame, groups: list[str], value: Column, *order: str | Column, name: str = "before") -> DataFrame:
    """`rows` with `name`: the sum of `value` over the rows of their group (null is a group as well) that come before them in `order`.

    A window sums within a partition of the sorted rows only; what partitions before hold comes from one row for each of them and group.
    """
    keys = [F.col(f"`{g}`") for g in groups]
    laid = stored(in_order(rows.withColumn("__value", value), *keys, *order)).withColumn("__part", F.shiftright("__at", _ROW_BITS))
    return _summed(laid, "__part", "__at", keys, name).drop("__at", "__part", "__value")


def _summed(laid: DataFrame, part: str, at: str, keys: list[Column], name: str) -> DataFrame:
    """Adds `name`, the sum of `__value` before a row, to a stored table that lies in ordered parts of bounded size."""
    marks = [f"__g{i}" for i in range(len(keys))]
    sums = laid.groupBy(F.col(part).alias("__of"), *[k.alias(m) for k, m in zip(keys, marks, strict=True)]).agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*marks).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.withColumn("__earlier", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum"))
    same = reduce(lambda a, b: a & b, [F.col(part) == F.col("__of"), *[k.eqNullSafe(F.col(m)) for k, m in zip(keys, marks, strict=True)]])
    inside = F.coalesce(F.sum("__value").over(Window.partitionBy(part, *keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return laid.withColumn("__inside", inside).join(sums, same).withColumn(name, F.col("__inside") + F.col("__earlier")).drop("__of", "__earlier", "__inside", *marks)
