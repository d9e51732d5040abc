"""Runs that can be stopped and taken up again: generations are committed one by one below a run's folder.

    <run>/generation-00002/<table>      a committed generation: Parquet tables, and `info.json`, written last
    <run>/_attempt-<id>/                one that is being written; renamed when it is whole
    <run>/_lease.json                   who works on the run, and until when

A reader sees whole generations only. Tables are written by tasks and read by tasks; the driver handles names and small JSON texts.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from types import TracebackType

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

LEASE_SECONDS = 600.0


class Locked(RuntimeError):
    """Another owner works on the run."""


class Folder:
    """The few file operations that a run needs, on any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _of(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def names(self) -> list[str]:
        folder = self._of(self.path)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._of(self.at(name)))

    def rename(self, name: str, to: str) -> bool:
        return not self.exists(to) and self.fs.rename(self._of(self.at(name)), self._of(self.at(to)))

    def delete(self, name: str) -> None:
        self.fs.delete(self._of(self.at(name)), True)

    def write(self, name: str, value: dict, overwrite: bool = True) -> None:
        out = self.fs.create(self._of(self.at(name)), overwrite)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()

    def read(self, name: str) -> dict:
        data = self.fs.open(self._of(self.at(name)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8"))
        finally:
            data.close()


class Run:
    """One run. `parameters` are compared with those it was begun with, so that it isn't continued with others."""

    def __init__(self, spark: SparkSession, path: str, parameters: dict | None = None, owner: str | None = None):
        self.spark, self.folder, self.owner, self.parameters = spark, Folder(spark, path), owner or uuid.uuid4().hex, parameters

    def __enter__(self) -> Run:
        self.lock()
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.unlock()

    def holder(self) -> str | None:
        """Who holds the run; a lease that has run out is nobody's."""
        if not self.folder.exists("_lease.json"):
            return None
        lease = self.folder.read("_lease.json")
        return lease["owner"] if lease["until"] > time.time() else None

    def lock(self, seconds: float = LEASE_SECONDS) -> None:
        """Take or renew the lease, or raise Locked. What a lost owner left half written goes."""
        held = self.holder()
        if held not in (None, self.owner):
            raise Locked(f"{self.folder.path} is held by {held}")
        if held is None:
            self.folder.delete("_lease.json")
        try:
            self.folder.write("_lease.json", {"owner": self.owner, "until": time.time() + seconds}, overwrite=held is not None)
        except Py4JJavaError as e:  # somebody was faster
            raise Locked(f"{self.folder.path} has just been taken") from e
        if held is None:
            for name in self.folder.names():
                if name.startswith("_attempt-"):
                    self.folder.delete(name)

    def unlock(self) -> None:
        if self.holder() == self.owner:
            self.folder.delete("_lease.json")

    def generations(self) -> list[int]:
        return [int(n.rpartition("-")[2]) for n in self.folder.names() if n.startswith("generation-")]

    def commit(self, generation: int, info: dict | None = None, **tables: DataFrame) -> dict[str, DataFrame]:
        """Write a generation's tables and make them visible at once; returns them as they were written."""
        self.lock()
        attempt, final = f"_attempt-{uuid.uuid4().hex}", f"generation-{generation:05}"
        for name, df in tables.items():
            df.write.parquet(self.folder.at(f"{attempt}/{name}"))
        self.folder.write(f"{attempt}/info.json", {"generation": generation, "tables": sorted(tables), "parameters": self.parameters, **(info or {})})
        if not self.folder.rename(attempt, final):
            self.folder.delete(attempt)
            raise Locked(f"{self.folder.at(final)} was committed by another owner")
        return self.load(generation)

    def info(self, generation: int) -> dict:
        return self.folder.read(f"generation-{generation:05}/info.json")

    def load(self, generation: int) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(self.folder.at(f"generation-{generation:05}/{name}")) for name in self.info(generation)["tables"]}

    def last(self) -> int | None:
        """The newest generation, None for a fresh run; a run of other parameters raises."""
        done = self.generations()
        if not done:
            return None
        known = self.info(done[-1])["parameters"]
        if known != json.loads(json.dumps(self.parameters)):
            raise ValueError(f"{self.folder.path} was begun with {known}")
        return done[-1]

    def finish(self) -> None:
        self.folder.write("finished.json", {"generation": max(self.generations(), default=None)})

    def remove(self) -> None:
        """Delete the run, unless somebody else works on it."""
        if self.holder() not in (None, self.owner):
            raise Locked(f"{self.folder.path} is in use")
        self.folder.delete("")


def resumable(spark: SparkSession, root: str) -> DataFrame:
    """The runs below `root` that have a committed generation and aren't finished: (name, generation, holder)."""
    rows = []
    for name in Folder(spark, root).names():
        run = Run(spark, f"{root.rstrip('/')}/{name}")
        done = run.generations()
        if done and not run.folder.exists("finished.json"):
            rows.append((name, done[-1], run.holder()))
    return spark.createDataFrame(rows, "name string, generation int, holder string")


class Stop:
    """Ends the jobs begun inside `with` after `seconds`, or as soon as `file` exists; `fired` tells whether it did.

    Jobs carry a tag, and a watching thread interrupts that tag until the block is left, so a running job ends within about a second, and
    so does one begun after. The error of a job that was ended this way doesn't leave the block.
    """

    def __init__(self, spark: SparkSession, seconds: float | None = None, file: str | None = None, every: float = 0.25):
        self.spark, self.seconds, self.file, self.every = spark, seconds, file, every
        self.fired, self.tag, self.left = False, f"stop-{uuid.uuid4().hex}", threading.Event()

    def due(self) -> bool:
        if self.seconds is not None and time.monotonic() - self.began >= self.seconds:
            return True
        folder, _, name = (self.file or "").rpartition("/")
        return bool(self.file) and Folder(self.spark, folder or ".").exists(name)

    def _watch(self) -> None:
        while not self.left.wait(self.every):
            self.fired = self.fired or self.due()
            if self.fired:
                self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def __enter__(self) -> Stop:
        self.began = time.monotonic()
        self.fired = self.due()
        self.spark.sparkContext.addJobTag(self.tag)
        self.watcher = threading.Thread(target=self._watch, daemon=True)
        if self.seconds is not None or self.file:
            self.watcher.start()
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> bool:
        self.left.set()
        if self.watcher.is_alive():
            self.watcher.join()
        self.spark.sparkContext.removeJobTag(self.tag)
        return self.fired and isinstance(error, (Py4JJavaError, PySparkException))
