"""Session helpers: where lineage may be cut, and when a side may be broadcast."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _cleaning, _before = threading.Lock(), 0, "false"
#: Paths staged inside each staging() block that is open.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset, a local session (as in tests) gets a fresh folder of its own; a cluster must name one, because
    executors do not see a folder of the driver's machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def _shuffles_cleaned(spark: SparkSession):
    """Drop the shuffle files of what is written inside, once it is written; threads of a session may overlap."""
    global _cleaning, _before
    with _lock:
        if not _cleaning:
            _before = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _cleaning += 1
    try:
        yield
    finally:
        with _lock:
            _cleaning -= 1
            if not _cleaning:
                spark.conf.set(CLEANUP, _before)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage with files that survive the loss of any executor, and lets several consumers read the same rows
    without computing them again. unstage() deletes the files once nothing reads them any more.
    """
    spark = df.sparkSession
    path = _new_path(spark, name)
    with _shuffles_cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def _new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/corpusgrid/{name}-{uuid.uuid4().hex}"
    with _lock:
        for paths in _open:
            paths.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unstage(*staged: DataFrame) -> None:
    """Delete what stage() wrote for these tables, when all that was built on them has been written itself."""
    for df in staged:
        _delete(df.sparkSession, df._staged_path)


@contextmanager
def staging(spark: SparkSession):
    """Deletes, at its end, all that was staged inside: write the result of a query inside, and nothing stays behind."""
    paths: list[str] = []
    with _lock:
        _open.append(paths)
    try:
        yield
    finally:
        with _lock:
            _open[:] = [x for x in _open if x is not paths]
        for path in paths:
            _delete(spark, path)


class Grown:
    """A staged table that grows by parts, such as what a search has visited: a part is written once, never again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.parts = spark, _new_path(spark, name), 0

    def add(self, df: DataFrame) -> DataFrame:
        """Write df as the next part; returns the part."""
        with _shuffles_cleaned(self.spark):
            df.write.parquet(f"{self.path}/part={self.parts}")
        self.schema, self.parts = df.schema, self.parts + 1
        return self.part(self.parts - 1)

    def part(self, k: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/part={k}")

    def table(self) -> DataFrame:
        """All parts."""
        out = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)
        out._staged_path = self.path
        return out


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once, so that they need no path to it of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusgrid_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="corpusgrid-"), "corpusgrid_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "corpusgrid")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._corpusgrid_shipped = True


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after counting df; beyond max_rows the optimizer chooses (sort-merge, AQE skew split)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def dealt(df: DataFrame, rows: int, *keys: str, per_task: int = 250_000) -> DataFrame:
    """df by keys over as many partitions as keep a task at about per_task of its rows, however large the input is.

    rows is the count of the table behind df (Parquet has it in its footers). What is grouped by more keys, or in windows
    by these, needs no further shuffle."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, rows // per_task + 1), *keys)
