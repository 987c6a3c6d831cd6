"""Cutting lineage where a result is read several times."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_marked: set[str] = set()
_scopes: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if "folder" not in _local:
        _local["folder"] = tempfile.mkdtemp(prefix="run-")
    return _local["folder"]


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def application_folder(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables; it goes when the application ends."""
    folder = f"{shared_folder(spark)}/spanlake-{spark.sparkContext.applicationId}"
    if folder not in _marked:
        where, files = _hadoop(spark, folder)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _marked.add(folder)
    return folder


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The same rows read back from a table in the shared folder.

    They survive the loss of executors, and later readers prune columns instead of recomputing.
    The table is deleted by ``released`` or at the end of the application.  ``compression`` is the codec of its files where
    the session's does not do.
    """
    path = f"{application_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for df in tables:
        where, files = _hadoop(df.sparkSession, df.written_path)
        files.delete(where, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at its end, the tables that ``written`` makes inside; what they lead to must have been stored by then."""
    _scopes.append([])
    try:
        yield
    finally:
        released(*_scopes.pop())
