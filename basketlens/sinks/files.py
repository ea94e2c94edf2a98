"""Folders of tables, through the file system that Spark itself uses."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``; 0 if it is not there."""
    system, at = _opened(spark, path)
    return system.getContentSummary(at).getLength() if system.exists(at) else 0


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Full names of the folders in ``path``; none if it is not there."""
    system, at = _opened(spark, path)
    if not system.exists(at):
        return []
    return [s.getPath().toString() for s in system.listStatus(at) if s.isDirectory()]


def remove_folder(spark: SparkSession, path: str) -> None:
    system, at = _opened(spark, path)
    system.delete(at, True)


def same_folder(spark: SparkSession, one: str, other: str) -> bool:
    """Whether two names, with or without scheme, are one folder."""
    names = []
    for path in (one, other):
        system, at = _opened(spark, path)
        names.append(system.makeQualified(at).toString())
    return names[0] == names[1]
