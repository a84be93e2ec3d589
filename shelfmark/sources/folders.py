"""Folders and marks on whatever file system Spark writes to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, fs = _opened(spark, path)
    return bool(fs.exists(found))


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies directly in the folder, in order; nothing if there is none."""
    found, fs = _opened(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(found)) if fs.exists(found) else []


def finished(spark: SparkSession, path: str) -> list[str]:
    """The subfolders that a write has finished."""
    return [f"{path}/{n}" for n in names(spark, path) if exists(spark, f"{path}/{n}/_SUCCESS")]


def mark(spark: SparkSession, path: str) -> None:
    """An empty file; its folder is made if there is none."""
    found, fs = _opened(spark, path)
    fs.create(found, True).close()


def remove(spark: SparkSession, path: str) -> None:
    found, fs = _opened(spark, path)
    fs.delete(found, True)
