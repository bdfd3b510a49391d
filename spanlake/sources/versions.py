"""Numbered folders that Spark has written in full: the steps by which stored tables change.

Spark writes ``_SUCCESS`` last, so a reader sees a step whole or not at all, and a step that is repeated replaces its own.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    fs, path = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def place(folder: str, kind: str, number: int) -> str:
    return f"{folder}/{kind}={number:020}"


def complete(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Numbers of the folders ``kind=<number>`` that are complete, in order."""
    numbers = [int(n.removeprefix(f"{kind}=")) for n in names(spark, folder) if n.startswith(f"{kind}=")]
    return [n for n in sorted(numbers) if "_SUCCESS" in names(spark, place(folder, kind, n))]


def delete(spark: SparkSession, folder: str) -> None:
    fs, path = _fs(spark, folder)
    fs.delete(path, True)
