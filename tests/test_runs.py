"""Runs: commits, leases, going on after a failure, and stopping in the middle of a generation."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from motifmill.operators import chain
from motifmill.plans import commands, discovery
from motifmill.plans.runs import Folder, Locked, Run, Stop, resumable


@pytest.fixture(scope="module")
def data(spark):
    pick = random.Random(5)
    core = "ACGTTGCA"
    rows = []
    for i in range(12):
        seq = [pick.choice("ACGT") for _ in range(40)]
        seq[10 + i % 4 : 18 + i % 4] = core
        rows.append((i, "".join(seq)))
    seqs = spark.createDataFrame(rows, "seq_id long, seq string")
    bundles = spark.createDataFrame([(i, float(i % 5), 14) for i in range(12)], "seq_id long, maxlog2fc double, summit long")
    counts = spark.createDataFrame([(p, b, 9 if core[p + 1] == b else 1) for p in range(5) for b in "ACGT"], "pos int, base string, count long")
    return seqs, bundles, counts


def find(data, run=None, generations=3, **options):
    return discovery.discover(*data, [(3, 0)], 1, 1, 9, generations=generations, accept=F.lit(True), briefing=False, run=run, **options)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def rounded(found):
    pool = found.pools.select("pool", "rank", "pattern", "label", F.round("score", 9))
    return rows_of(pool), rows_of(found.occurrences.select("generation", "pattern", "label", "seq_id", "start", "size"))


def test_a_killed_run_goes_on(spark, data, tmp_path, monkeypatch):
    whole = rounded(find(data))
    assert {r[0] for r in whole[1]} >= {0, 1, 2}
    step, calls = chain.chain_step, []

    def failing(*args, **options):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return step(*args, **options)

    monkeypatch.setattr(chain, "chain_step", failing)
    with pytest.raises(KeyboardInterrupt):
        find(data, Run(spark, str(tmp_path / "r"), {"a": 1}))
    assert Run(spark, str(tmp_path / "r")).generations() == [0, 1]
    assert [(r["name"], r["generation"]) for r in resumable(spark, str(tmp_path)).collect()] == [("r", 1)]
    monkeypatch.setattr(chain, "chain_step", step)
    with pytest.raises(ValueError, match="begun with"):
        find(data, Run(spark, str(tmp_path / "r"), {"a": 2}))
    left = Run(spark, str(tmp_path / "r"))
    left.folder.delete("_lease.json")  # its owner is gone
    left.folder.write("_attempt-x/part", {})
    with Run(spark, str(tmp_path / "r"), {"a": 1}) as run:
        assert rounded(find(data, run)) == whole
        assert not any(n.startswith("_attempt") for n in run.folder.names())
        run.finish()
    assert resumable(spark, str(tmp_path)).count() == 0
    run.remove()
    assert Folder(spark, str(tmp_path)).names() == []


def test_leases(spark, tmp_path):
    one, other = (Run(spark, str(tmp_path / "r"), owner=x) for x in ("one", "other"))
    with one:
        one.lock()  # renewed
        with pytest.raises(Locked):
            other.lock()
        with pytest.raises(Locked):
            other.remove()
        one.commit(0, {"q": 3}, numbers=spark.range(3))
        assert one.info(0)["q"] == 3 and one.load(0)["numbers"].count() == 3
        with pytest.raises(Locked):
            one.commit(0, numbers=spark.range(4))
        assert one.load(0)["numbers"].count() == 3
    other.lock(seconds=-1)
    one.lock()  # the other's lease has run out
    assert one.holder() == "one"


def test_a_running_job_is_stopped(spark, tmp_path):
    began = time.monotonic()
    with Stop(spark, seconds=1.0) as stop:
        spark.range(1 << 50).select(F.sum(F.hash("id"))).collect()
    assert stop.fired and time.monotonic() - began < 20
    (tmp_path / "end").write_text("")
    with Stop(spark, file=str(tmp_path / "end")) as stop:
        assert stop.fired
    with pytest.raises(ZeroDivisionError), Stop(spark, seconds=60) as stop:
        1 / 0  # noqa: B018
    assert not stop.fired and spark.range(3).count() == 3


def test_a_stopped_generation_leaves_the_ones_before(spark, data, tmp_path, monkeypatch):
    one = rounded(find(data, generations=1))
    step, calls = chain.chain_step, []

    def slow(*args, **options):
        calls.append(1)
        if len(calls) == 2:
            (tmp_path / "stop").write_text("")
            spark.range(1 << 50).select(F.sum(F.hash("id"))).collect()
        return step(*args, **options)

    monkeypatch.setattr(chain, "chain_step", slow)
    began = time.monotonic()
    got = find(data, stop_file=str(tmp_path / "stop"))
    assert time.monotonic() - began < 100 and len(calls) == 2
    assert rounded(got) == one


def write_inputs(folder, data):
    seqs, bundles, counts = (df.collect() for df in data)
    (folder / "s.fasta").write_text("".join(f">{r['seq_id']}\n{r['seq']}\n" for r in seqs))
    (folder / "b.txt").write_text("".join(f"> id={r['seq_id']}\nFDR,0.1\nmaxlog2FC,{r['maxlog2fc']}\nsummit,{r['summit']}\n" for r in bundles))
    cells = {(r["pos"], r["base"]): r["count"] for r in counts}
    (folder / "m.pfm").write_text(">M\n" + "".join(f"{b} [ {' '.join(str(cells[p, b]) for p in range(5))} ]\n" for b in "ACGT"))
    return ["--sequences", str(folder / "s.fasta"), "--bundle", str(folder / "b.txt"), "--pfm", str(folder / "m.pfm"), "--frames", "3", "--distances", "0", "--overlap", "1", "--gap", "1", "--quorum", "9"]


def test_command_resumes(spark, data, tmp_path, capsys):
    inputs = write_inputs(tmp_path, data)
    commands.main(["MFC", *inputs, "--output", str(tmp_path / "a"), "--generations", "2"])
    commands.main(["MFC", *inputs, "--output", str(tmp_path / "b"), "--generations", "1", "--scores", "ssmart,summit,jaspar"])
    Folder(spark, str(tmp_path / "b/data_f3_d0/run")).delete("finished.json")
    commands.main(["RUN", "--output", str(tmp_path / "b")])
    assert capsys.readouterr().out == "data_f3_d0\tgeneration 1\tfree\n"
    with pytest.raises(SystemExit):
        commands.main(["MFC", *inputs, "--output", str(tmp_path / "b"), "--generations", "2"])
    commands.main(["MFC", *inputs, "--output", str(tmp_path / "b"), "--generations", "2", "--resume"])
    a, b = (rows_of(spark.read.parquet(str(tmp_path / x / "data_f3_d0" / "pools")).select("pool", "rank", "pattern", "label")) for x in "ab")
    assert a == b and len(a) > 3
    commands.main(["RUN", "--output", str(tmp_path / "b"), "--remove", "data_f3_d0"])
    assert not Folder(spark, str(tmp_path / "b/data_f3_d0")).exists("run")
