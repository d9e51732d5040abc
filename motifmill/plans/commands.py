"""The command line: python -m motifmill COMMAND --option value ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import align, evaluate, neighbourhood
from ..sources import readers, writers
from . import discovery
from .runs import Folder, Run, resumable


def numbers(text: str) -> list[int]:
    """Numbers set apart by '-', as 5-6."""
    return [int(x) for x in text.split("-")]


def neighbourhoods(spark: SparkSession, a: argparse.Namespace, first: int, last: int) -> None:
    near = neighbourhood.neighbourhood(neighbourhood.kmers(spark, first, last), a.kmin, a.kmax, a.dmax)
    neighbourhood.write_neighbourhood(near, a.output, a.kmin, a.kmax, a.dmax, range(first, last + 1))


def single_level(spark: SparkSession, a: argparse.Namespace) -> None:
    neighbourhoods(spark, a, a.level[0], a.level[0])


def levels(spark: SparkSession, a: argparse.Namespace) -> None:
    neighbourhoods(spark, a, a.level[0], a.level[-1])


#: What a run's result depends on; a run is taken up again only with the same.
PARAMETERS = ("sequences", "bundle", "pfm", "frames", "distances", "overlap", "gap", "quorum", "lexicon", "end_bound", "dedup", "scores", "neighbourhood")


def motifs(spark: SparkSession, a: argparse.Namespace) -> None:
    """Discovers motifs; every generation is committed to the run's folder, so that the same command with --resume goes on from there."""
    seqs = readers.fasta(spark, a.sequences).select("seq_id", "seq")
    bundles = readers.bundle(spark, a.bundle).select("seq_id", "maxlog2fc", "summit")
    counts = readers.pfm(spark, a.pfm).select("pos", "base", "count")
    name = f"{a.output}/{writers.checkpoint_name(a.name, a.frames, a.distances)}"
    known = neighbourhood.open_neighbourhood(spark, a.neighbourhood) if a.neighbourhood else None
    with Run(spark, f"{name}/run", {p: getattr(a, p) for p in PARAMETERS}) as run:
        if not a.resume and run.generations():
            raise SystemExit(f"{name}/run holds generations of an earlier run; use --resume, or remove it")
        found = discovery.discover(
            seqs, bundles, counts, list(zip(a.frames, a.distances, strict=True)), a.overlap, a.gap, a.quorum, a.lexicon, a.generations, scorers=a.scores.split(","), known=known, run=run,
            seconds=a.seconds, stop_file=a.stop_file, end_bound=a.end_bound, dedup=a.dedup,
        )
        writers.save_checkpoint(name, lexicon=found.lexicon, occurrences=found.occurrences, scores=found.scores, pools=found.pools)
        kept = found.pools.select("pattern", "label").distinct()
        writers.write_results(found.occurrences.join(kept.select("pattern"), "pattern", "left_semi").select("pattern", "seq_id", "start", "size"), kept, run.load(0)["sequences"], f"{name}/results")
        run.finish()


def runs(spark: SparkSession, a: argparse.Namespace) -> None:
    """Lists the runs below --output that can be taken up again; with --remove, deletes the named one."""
    if a.remove:
        Run(spark, f"{a.output}/{a.remove}/run").remove()
    for folder in Folder(spark, a.output).names():
        for r in resumable(spark, f"{a.output}/{folder}").collect():
            print(f"{folder}\tgeneration {r['generation']}\t{'held by ' + r['holder'] if r['holder'] else 'free'}")


def distances(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.results(spark, a.results)
    members = rows.select(F.col("label").alias("group"), F.col("substring").alias("text")).unionByName(rows.select(F.col("label").alias("group"), F.translate("label", "|", "").alias("text")))
    evaluate.distance_matrix(members).write.mode("overwrite").parquet(a.output)


def statistics(spark: SparkSession, a: argparse.Namespace) -> None:
    site_id = F.monotonically_increasing_id().cast("string")
    found = readers.results(spark, a.results).select(F.col("label").alias("pattern"), site_id.alias("motif_id"), "seq_id", F.col("start").alias("rel_start"), "length")
    sites = readers.known_instances(spark, a.sites, a.name).select(site_id.alias("site_id"), "seq_id", F.col("start").alias("rel_start"), "length")
    evaluate.raw_statistics_by(found, sites, readers.fasta(spark, a.sequences).select("seq_id", "seq")).write.mode("overwrite").parquet(a.output)


def alignment(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.results(spark, a.results).select(F.col("label").alias("group"), F.col("at").alias("id"), F.col("substring").alias("text"))
    align.align(rows).write.mode("overwrite").parquet(a.output)


COMMANDS = {"SLD": single_level, "FLD": levels, "MFC": motifs, "SDM": distances, "ARS": statistics, "ALG": alignment, "RUN": runs}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("motifmill", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    for name in ("sequences", "bundle", "pfm", "results", "sites"):
        p.add_argument(f"--{name}")
    p.add_argument("--output", required=True)
    p.add_argument("--name", default="data")
    p.add_argument("--scores", default="ssmart,summit,jaspar", help="registered scores, set apart by commas")
    p.add_argument("--end-bound", choices=("native", "python"), default="native")
    for name, about in (("dedup", "count equal occurrences once"), ("resume", "go on after the last committed generation")):
        p.add_argument(f"--{name}", action="store_true", help=about)
    p.add_argument("--seconds", type=float, help="end the generation in work after so long")
    for name, about in (("stop-file", "end the generation in work once this file exists"), ("neighbourhood", "a store that SLD or FLD wrote"), ("remove", "the run that RUN deletes")):
        p.add_argument(f"--{name}", help=about)
    for name, default in (("level", "5"), ("frames", "6"), ("distances", "1")):
        p.add_argument(f"--{name}", type=numbers, default=numbers(default))
    for name, default in (("kmin", 5), ("kmax", 7), ("dmax", 1), ("overlap", 2), ("gap", 3), ("quorum", None), ("lexicon", 0), ("generations", 10)):
        p.add_argument(f"--{name}", type=int, default=default)
    a = p.parse_args(args)
    COMMANDS[a.command](SparkSession.builder.appName("motifmill").getOrCreate(), a)
