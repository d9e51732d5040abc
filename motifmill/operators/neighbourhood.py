"""Complete k-mer sets, distance-1 graphs and d-neighbourhoods."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kmers import ALPHABET, neighbours
from ..plans.runs import Folder
from ..plans.state import stored


def kmers(spark: SparkSession, first: int, last: int | None = None) -> DataFrame:
    """(kmer) of every word of `first` to `last` letters, made level by level in one plan."""
    level, out = spark.range(1).select(F.lit("").alias("kmer")), None
    for k in range(1, (last or first) + 1):
        level = level.select(F.explode(F.array(*[F.concat("kmer", F.lit(x)) for x in ALPHABET])).alias("kmer"))
        if k >= first:
            out = level if out is None else out.unionByName(level)
    return out


def edges(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """(kmer, neighbour) at distance 1 among all words of `first` to `last` letters, from the given k-mers. That set is
    complete, so a filter on the length takes the place of a join."""
    pairs = nodes.select("kmer", F.explode(neighbours(F.col("kmer"))).alias("neighbour"))
    return pairs.where(F.length("neighbour").between(first, last))


def neighbourhood(nodes: DataFrame, first: int, last: int, dmax: int) -> DataFrame:
    """(kmer, neighbour, distance): words within dmax steps in the distance-1 graph over `first` to `last` letters, each with
    its least distance, without the k-mer itself."""
    seen = nodes.select("kmer", F.col("kmer").alias("neighbour"), F.lit(0).alias("distance"))
    rim = seen
    for d in range(1, dmax + 1):
        rim = rim.select("kmer", F.explode(neighbours(F.col("neighbour"))).alias("neighbour")).where(F.length("neighbour").between(first, last)).distinct().withColumn("distance", F.lit(d))
        seen = seen.unionByName(rim)
    return seen.groupBy("kmer", "neighbour").agg(F.min("distance").alias("distance")).where("distance > 0")


def missing(expected: DataFrame, present: DataFrame) -> DataFrame:
    """k-mers of `expected` that a stored data set lacks."""
    return expected.join(present.select("kmer").distinct(), "kmer", "left_anti")


#: Buckets of a stored neighbourhood.
BUCKETS = 64
_LIMITS = "_neighbourhood.json"


@dataclass(frozen=True)
class Neighbourhood:
    """A stored neighbourhood (kmer, neighbour, distance, k) with its limits: neighbours of kmin to kmax letters within dmax steps, for
    all k-mers of the lengths in `levels`."""

    table: DataFrame
    path: str
    kmin: int
    kmax: int
    dmax: int
    levels: tuple[int, ...]

    def near(self, k: int, d: int, first: int, last: int) -> DataFrame:
        """(kmer, neighbour) of the k-mers' neighbours of `first` to `last` letters within d steps; ValueError if the store doesn't hold
        them. Beyond one step the lengths must be those of the store, since steps go over words of all its lengths."""
        if k not in self.levels or d > self.dmax or first < self.kmin or last > self.kmax or (d > 1 and (first, last) != (self.kmin, self.kmax)):
            raise ValueError(f"{self.path} holds {self.kmin} to {self.kmax} letters within {self.dmax} of {self.levels}, not {first} to {last} within {d} of {k}")
        return self.table.where((F.col("k") == k) & (F.col("distance") <= d) & F.length("neighbour").between(first, last)).select("kmer", "neighbour")


def _table_of(spark: SparkSession, path: str, buckets: int) -> str:
    """The name of a bucketed table over the files of `path`, made in this session's catalog if it isn't there."""
    name = f"neighbourhood_{zlib.crc32(path.encode()):08x}"
    if not spark.catalog.tableExists(name):
        where = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} (kmer STRING, neighbour STRING, distance INT, k INT) USING parquet CLUSTERED BY (kmer) SORTED BY (k, kmer) INTO {buckets} BUCKETS LOCATION '{where}'")
    return name


def _append(table: DataFrame, path: str, buckets: int) -> None:
    spark, name = table.sparkSession, _table_of(table.sparkSession, path, buckets)
    rows = table.select("kmer", "neighbour", F.col("distance").cast("int"), F.length("kmer").alias("k"))
    rows.repartition(buckets, "kmer").write.insertInto(name)
    spark.catalog.refreshTable(name)


def write_neighbourhood(table: DataFrame, path: str, kmin: int, kmax: int, dmax: int, levels: Sequence[int], buckets: int = BUCKETS) -> Neighbourhood:
    """Store a neighbourhood as an index: bucketed and sorted by k-mer, with its limits beside it. A join by k-mer reads the buckets as
    they are. An earlier store in `path` is replaced."""
    spark, folder = table.sparkSession, Folder(table.sparkSession, path)
    folder.delete("")
    spark.sql(f"DROP TABLE IF EXISTS neighbourhood_{zlib.crc32(path.encode()):08x}")
    _append(table, path, buckets)
    folder.write(_LIMITS, {"kmin": kmin, "kmax": kmax, "dmax": dmax, "levels": sorted(set(levels)), "buckets": buckets})
    return open_neighbourhood(spark, path)


def open_neighbourhood(spark: SparkSession, path: str) -> Neighbourhood:
    limits = Folder(spark, path).read(_LIMITS)
    return Neighbourhood(spark.table(_table_of(spark, path, limits["buckets"])), path, limits["kmin"], limits["kmax"], limits["dmax"], tuple(limits["levels"]))


def repair(spark: SparkSession, path: str) -> DataFrame:
    """Append what is missing to a stored neighbourhood; returns the k-mers that were."""
    store = open_neighbourhood(spark, path)
    expected = kmers(spark, min(store.levels), max(store.levels)).where(F.length("kmer").isin(list(store.levels)))
    lost = stored(missing(expected, store.table))  # of before the write
    _append(neighbourhood(lost, store.kmin, store.kmax, store.dmax), path, Folder(spark, path).read(_LIMITS)["buckets"])
    return lost
