"""Folders on the storage that all executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def make(spark: SparkSession, path: str) -> None:
    system, place = _place(spark, path)
    system.mkdirs(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    system, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``."""
    system, place = _place(spark, path)
    return system.getContentSummary(place).getLength() if system.exists(place) else 0


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a folder in one step; False if there is nothing to move or the target exists."""
    system, place = _place(spark, path)
    target = _place(spark, to)[1]
    if not system.exists(place) or system.exists(target):
        return False
    system.mkdirs(target.getParent())
    return system.rename(place, target)


def remove(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.delete(place, True)


def changed(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Newest change, number and bytes of the files of a table, to tell whether it is still the same."""
    system, place = _place(spark, path)
    files = [s for s in system.listStatus(place) if not s.isDirectory()]
    return max((s.getModificationTime() for s in files), default=0), len(files), sum(s.getLen() for s in files)
