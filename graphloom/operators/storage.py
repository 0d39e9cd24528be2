"""Tables and files that a computation leaves on its way, in a folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_at_exit: set[str] = set()
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path on any storage that Spark can read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, whether it is a folder) of what lies in a folder; nothing for a file or a path that isn't there."""
    files, place = file_system(spark, path)
    if not files.exists(place) or not files.getFileStatus(place).isDirectory():
        return []
    return sorted((s.getPath().getName(), s.isDirectory()) for s in files.listStatus(place))


def delete(spark: SparkSession, path: str) -> None:
    files, place = file_system(spark, path)
    files.delete(place, True)


def folder(spark: SparkSession) -> str:
    """Where such tables go: spark.checkpoint.dir. Where it is unset, a folder of our own does if driver and workers are on one machine.

    The application's part of it goes when the driver ends.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="graphloom-")
        found = _own[sc.applicationId]
    out = f"{found.rstrip('/')}/graphloom-{sc.applicationId}"
    if out not in _at_exit:
        _at_exit.add(out)
        files, place = file_system(spark, out)
        files.mkdirs(place)
        files.deleteOnExit(place)
    return out


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Leaving the block deletes what was stored within it, results that were kept too: for sessions that go on after a result has been read.

    Without one, such tables go when the driver ends.
    """
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            delete(spark, path)


def new_path(spark: SparkSession) -> str:
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    if (paths := _scope.get()) is not None:
        paths.append(path)
    return path


def stored(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path: lineage ends here. Its shuffle files go as soon as it is written."""
    path = new_path(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path
