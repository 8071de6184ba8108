"""Session defaults, lineage cuts and size checks shared by every operator."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Largest model-sized state, in doubles, that may travel to the driver or into a task.
MAX_STATE = 8_000_000
# Shuffle files of a query are deleted when it ends, and not when the driver happens to collect its garbage (Spark 4.1).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()
_written: dict[str, list[str]] = {}


def configure(builder: SparkSession.Builder, partitions: int | None = None) -> SparkSession.Builder:
    """The settings the operators are tuned for; a cluster's own submit settings may override them."""
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application (what ``--py-files`` does at submit)."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="cumulus-ship-"), "cumulus")
        spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", root, "cumulus"))
        _shipped.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="cumulus-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, known size, safe to lose executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> int:
    """Delete every table this application cut so far; call it once the results that read them are stored."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame, name: str = "spread") -> DataFrame:
    """The input of an iterative job as a written table with at least a file per core, so no round computes it again."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files and all("/" + name + "-" in f for f in files):
        return df
    out, cores = materialise(df, name), spark.sparkContext.defaultParallelism
    return out if len(out.inputFiles()) >= cores else materialise(out.repartition(cores), name)


class Rounds:
    """Lineage cuts of an iterative job: each new round replaces the one before the last, and its shuffle files go once it is written."""

    def __init__(self, name: str):
        self.name = name
        self.paths: list[str] = []

    def cut(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = scratch_path(spark, self.name)
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
        _written.setdefault(spark.sparkContext.applicationId, []).append(path)
        self.paths.append(path)
        if len(self.paths) > 2:
            _delete(spark, self.paths.pop(0))
        return spark.read.schema(df.schema).parquet(path)


def check_state(cells: int, what: str) -> None:
    if cells > MAX_STATE:
        raise ValueError(f"{what} needs {cells} numbers of model state; the bound is {MAX_STATE}")
