"""Folders of tables: what is in them, and their removal."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none if it does not exist."""
    files, folder = _at(spark, path)
    if not files.exists(folder):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(folder) if f.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    files, folder = _at(spark, path)
    files.delete(folder, True)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint; another checkpoint has another."""
    line = spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()
    return line.id
