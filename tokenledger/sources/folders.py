"""Numbered sub-folders of a stored table, on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, wherever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def numbered(spark: SparkSession, path: str, marker: str, committed: bool = False) -> list[int]:
    """The numbers of the sub-folders ``marker=N``, rising; ``committed``: of those with a _SUCCESS file."""
    fs, p = folder(spark, path)
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith(f"{marker}=")]
    if committed:
        found = [x for x in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(int(x.getName().split("=")[1]) for x in found)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = folder(spark, path)
    fs.delete(p, True)
