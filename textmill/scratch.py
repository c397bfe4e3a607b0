"""Tables that one run writes and reads again, in the folder that all executors share.

Results of model calls must not be computed twice, so they are written here rather
than cached: a lost executor costs one re-read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch for deleting the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_kept: set[str] = set()
#: Tables made within each open ``scope``.
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where none is set, a temporary one if driver and executors are one process
    (``local`` masters); on a cluster that is an error, as executors don't share such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="textmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, name: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(name)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and returns the table read back; it lives until the driver's JVM ends."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/textmill-{spark.sparkContext.applicationId}"
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    with _own_shuffles(spark):
        df.write.parquet(path)
    if root not in _kept:
        files, target = _path(spark, root)
        files.deleteOnExit(target)
        _kept.add(root)
    out = spark.read.schema(df.schema).parquet(path)
    out._textmill_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries begun within delete their shuffle files at their end; else these lie on the executors' disks until the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Gives the list of tables stashed within it, and deletes those in it at its end."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.pop()
        for df in made:
            drop(df)


def drop(df: DataFrame) -> None:
    """Deletes a table made by ``stash`` that no later plan reads."""
    if path := getattr(df, "_textmill_path", None):
        files, target = _path(df.sparkSession, path)
        files.delete(target, True)
